"""The corpus operators against brute force, exact round trips, SQL and held-out accuracy."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gapweave.llm import decontamination, language_id, line_dedup, nearest, ngram_join, queries, sentencepiece_bpe, token_counts, toxicity, vbyte, warc
from gapweave.llm.common import scratch, table

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "  a  b ", "日本語 x", "\n\n a\n", "▁x ▁", "\x00a\x01 b", "a\tb", "😀 x😀", "<|endoftext|> x", "<s> <unk>", "x" * 3000, "one two three"]
SCHEMA = "doc_id long, text string, source string, lang string, gw_id long, score string"


def odd_docs(spark, texts=ODD):
    rows = [(k, t, None if k % 3 else "s", None, 1, "z") for k, t in enumerate([*texts, *texts])]
    return spark.createDataFrame([*rows, (None, "a b c d e f", None, None, None, None), rows[0]], SCHEMA)


def random_texts(n=300):
    rng = random.Random(5)
    return ["".join(rng.choice("ab  \n▁é日😀.,<>&0 sthe") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_sentencepiece_is_exact(spark):
    path = queries.vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*ODD, *random_texts(), *[r.text for r in table(spark, SF, "documents").collect()]]
    got = sentencepiece_bpe.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        ids = sp.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    ids = spark.createDataFrame([("a  b",)], "t string").select(sentencepiece_bpe.encode(F.col("t"), path).alias("i"))
    assert ids.select(sentencepiece_bpe.decode(F.col("i"), path)).first()[0] == "a  b"


def test_token_files_and_counts(spark):
    path = queries.vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    docs = table(spark, SF, "documents").select("doc_id", "text").unionAll(spark.createDataFrame([(1000 + k, t) for k, t in enumerate([*ODD, *random_texts()])], "doc_id long, text string"))
    got = {r.doc_id: r for r in vbyte.write_and_read(docs, path, file_ids=20_000, block_ids=5_000).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        assert tuple(got[r.doc_id]) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    tok.encode_special_tokens = True
    counts = {r.doc_id: r for r in token_counts.write_and_count(docs.repartition(3), path, 50256, block_ids=777).collect()}
    assert {k: r.n_tokens for k, r in counts.items()} == {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    spans = sorted((r.start, r.n_tokens) for r in counts.values())
    assert all(a + n + 1 == b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_variable_length_codes():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 1 << rng.integers(1, 33), n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 5, 0, 8, 3)]
    coded = [vbyte.encode_ranks(p) for p in parts]
    back = vbyte.decode_ranks(b"".join(c for c, _ in coded), b"".join(d for _, d in coded), np.array([len(p) for p in parts]))
    assert (back == np.concatenate(parts)).all()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, df.select(columns).collect())) == sorted(f"Row({', '.join(f'{c}={v!r}' for c, v in zip(columns, r))})" for r in want.select(*columns).fetchall())


def links(texts):
    sets = []
    for t in texts:
        w = regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set())
    return [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] & sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]


def test_join_finds_what_brute_force_finds(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)  # many blocks for few copies
    rng = random.Random(1)
    base = [f"w{k}" for k in range(200)]
    copies = [" ".join(w if rng.random() > 0.005 else "x" for w in base) for _ in range(40)]
    texts = [r.text for r in table(spark, SF, "documents").orderBy("doc_id").collect()] + ODD + copies + copies[:3]
    got = {r.doc_id: r for r in ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = links(texts)
    root, n = list(range(len(texts))), [0] * len(texts)
    for a, b in found:
        n[a], n[b] = n[a] + 1, n[b] + 1
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert [(got[k].class_id, got[k].n_links) for k in range(len(texts))] == list(zip(root, n, strict=True))


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (5004, [1.0])]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=10).collect()
    hits = 0
    for q in range(0, 2000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, *_ in mine] == list(range(1, 11)) and all(abs(s[v] - y) < 1e-9 for _, v, y in mine)
        hits += len({v for _, v, _ in mine} & set(np.argsort(-s)[:10].tolist()))
    assert hits >= 0.9 * 1000


def test_warc_round_trip(spark):
    html = "é" * 600
    pages = spark.createDataFrame([(1, "http://a", html), (2, None, html), (3, "u\nv", html), (3, "u\nv", html), (4, "x", "small"), (5, "y", "small"), (6, "z", None), (None, "n", html)], "page_id long, url string, html string")
    path = scratch(spark, "warc-test")
    got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(pages, path).collect())
    assert got == sorted([("1", "revisit", 3, 1200), ("2", "revisit", 3, 1200), ("3", "response", None, 1200), ("3", "response", None, 1200), ("4", "response", None, 5), ("5", "response", None, 5), ("6", "response", None, 0), ("None", "revisit", 3, 1200)])
    full = warc.read(spark, path).where("record_type = 'response' AND payload_bytes >= 5 AND record_id LIKE '<urn:page:%'")
    assert sorted(bytes(r.payload).decode() for r in full.collect()) == ["small", "small", html, html]


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    lang = table(spark, sf, "documents").select("doc_id", "lang")
    r = queries.op7_language_id(spark, sf).join(lang, "doc_id").where("held_out")
    assert r.where("lang = lang_pred").count() >= 0.97 * r.count()
    toxic = table(spark, sf, "labels").select("doc_id", "toxic")
    r = queries.op3_toxicity(spark, sf).join(toxic, "doc_id").where("held_out")
    hits, flagged, toxic = (r.where(x).count() for x in ("toxic = 1 AND predicted = 1", "predicted = 1", "toxic = 1"))
    assert hits >= 0.7 * toxic and hits >= 0.9 * flagged and toxic >= 15


def test_odd_and_empty_tables(spark):
    docs, none = odd_docs(spark), odd_docs(spark).limit(0)
    model = queries.toxicity_model(spark, SF)
    lang = language_id.fit(table(spark, SF, "documents"))
    items = spark.createDataFrame([(1, "a b c d e f"), (2, None), (None, "x")], "item_id long, text string")
    for d, n in ((docs, docs.count()), (none, 0)):
        assert toxicity.score(d, model).count() == n and toxicity.drop_toxic(d, model).columns == d.columns
        assert language_id.predict(d.select("doc_id", "text"), lang).count() == n
        assert line_dedup.drop_boilerplate(d).count() == n and line_dedup.drop_boilerplate(d).columns == d.columns
        assert ngram_join.join(d).count() == n
        # "x" is an item of one word, which eight texts with a number and the row (None, "a b c d e f") hold or are held by
        held = [r for r in d.collect() if "x" in regex.findall(r"[\p{L}\p{N}]+", (r.text or "").lower()) or r.text == "a b c d e f"]
        assert decontamination.contained(d, items).count() == len({r.doc_id for r in held})
        assert decontamination.drop_contaminated(d, items).count() == n - len(held)
        path = queries.vocabulary("byte_bpe_50k.json")
        assert vbyte.write_and_read(d, path).count() == n and token_counts.write_and_count(d.where("doc_id > 0").dropDuplicates(["doc_id"]), path, 50256).count() == max(n - 3, 0)
    assert nearest.search(table(spark, SF, "embeddings").limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert public_tokenizers.path("piece_bpe_32k.model")


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = table(spark, SF, "documents")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out
    kept = p.STAGES[2][1](spark, docs, SF)
    assert kept.count() == docs.count() and not links([r.text for r in kept.collect()])


def test_toxicity_thresholds_come_from_the_counts_of_all_labelled_rows(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels").where("toxic IS NOT NULL").select("doc_id", "toxic")
    docs = table(spark, sf, "documents").join(labels, "doc_id").select("doc_id", "text", "lang", "toxic")
    long = docs.where("toxic = 1").limit(3).withColumn("text", F.repeat("text", 200)).withColumn("doc_id", -F.col("doc_id") - 1)
    both, seen = docs.unionAll(long), []
    monkeypatch.setattr(toxicity, "thresholds", lambda counts, groups, own=toxicity.thresholds: seen.append(counts) or own(counts, groups))
    model = toxicity.fit(both.drop("toxic"), both.select("doc_id", "toxic"), sample_rows=100)
    assert seen[0]["n"].sum() == both.count()
    counts, best = seen[0], {}
    for g in [None, *sorted(set(counts["group"]))]:  # the best threshold by trying every bin
        rows = counts if g is None else counts[counts["group"] == g]
        toxic = rows["n"][rows["label"] == 1].sum()
        f1 = lambda b: 2 * rows["n"][(rows["bin"] >= b) & (rows["label"] == 1)].sum() / (rows["n"][rows["bin"] >= b].sum() + toxic)  # noqa: B023, E731
        best[g] = (toxic, rows["label"].nunique(), max((f1(b), -b) for b in set(rows["bin"])))
    for g, (toxic, kinds, (_, low)) in best.items():
        if g is not None and kinds == 2:
            between = (model.thresholds[g] * (toxic + toxicity.SHRINK) - toxicity.SHRINK * toxicity.best_threshold(counts)) / toxic
            below = [b for b in counts["bin"][counts["group"] == g] if b < -low]
            assert -low * toxicity.BIN + 1e-9 >= between >= (max(below) * toxicity.BIN if below else -np.inf) - 1e-9
