"""Odd rows, clashing column names, long texts and plain loops beside the corpus operators."""

import io
import random
import string
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gapweave.llm import byte_bpe, decontamination, language_id, line_dedup, nearest, ngram_join, queries, sentencepiece_bpe, token_counts, toxicity, vbyte, warc
from gapweave.llm.common import bounded_batches, scratch, table
from gapweave.llm.features import ngrams

SF = "/root/testdata/sf0.001"
#: Names that operators use for columns of their own, and names of results.
CLASHING = "gw_id gw_found gw_host gw_lines gw_text gw_row score lang_pred predicted n_lines n_dropped print class_id item_id shared h n band node".split()
WORDS = " ".join(f"w{k}" for k in range(40))


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with matches for every operator and columns of all clashing names."""
    texts = [WORDS, WORDS + " end", "menu\n" + WORDS.upper() + "\nfoot", "menu\nsome other page of few words\nfoot", None, "", WORDS]
    rows = [(k, t, "host", "en") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").select("*", *[F.lit("z").alias(c) for c in CLASHING])


def test_clashing_names(spark, clashing):
    d, n = clashing, clashing.count()
    items = spark.createDataFrame([(9, WORDS)], "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("h", F.lit(2))
    found = decontamination.contained(d, items).collect()
    assert sorted((r.doc_id, r.item_id, r.shared) for r in found) == [(0, 9, 36), (1, 9, 36), (2, 9, 36), (6, 9, 36)]
    for kept, ids in ((decontamination.drop_contaminated(d, items), {3, 4, 5}), (ngram_join.keep_first(d), {0, 3, 4, 5})):
        assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == ids and all(r.gw_id == "z" for r in kept.collect())
    clean = {r.doc_id: r for r in line_dedup.drop_boilerplate(d).collect()}
    assert clean[3].text == "some other page of few words" and clean[2].text == WORDS.upper() and clean[3].gw_host == "z" and clean[4].text is None
    report = line_dedup.drop_boilerplate(d, report=True)
    assert len(set(report.columns)) == len(report.columns) and {r.doc_id: r.n_dropped for r in report.collect()}[3] == 2
    lang = language_id.predict(d, language_id.fit(table(spark, SF, "documents")))
    assert lang.columns.count("score") == 1 and lang.where("lang_pred = 'und' AND score = 0").count() == 2
    model = queries.toxicity_model(spark, SF)
    scored = toxicity.score(d, model)
    assert scored.columns.count("score") == 1 and scored.where("score BETWEEN 0 AND 1 AND gw_text = 'z'").count() == n
    assert toxicity.drop_toxic(d, model).columns == d.columns
    path = queries.vocabulary("byte_bpe_50k.json")
    assert vbyte.write_and_read(d, path).count() == n and token_counts.write_and_count(d, path, 50256).count() == n
    assert sentencepiece_bpe.digests(d, queries.vocabulary("piece_bpe_32k.model")).count() == n


def test_small_hosts_and_repeated_lines(spark):
    rows = [(1, "a", "x\ny"), (2, "a", "x\nz\n z "), (3, "b", "x\nx"), (4, None, "q\nr"), (5, None, "q\ns"), (5, None, "q\ns")]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id int, source string, text string")).collect()
    want = []
    for k, host, text in rows:  # a line goes if it is on two pages or more, and on over a tenth of its host's
        pages = [set(map(str.strip, t.split("\n"))) for _, h, t in rows if h == host]
        on = lambda line: sum(line.strip() in p for p in pages)  # noqa: B023, E731
        want.append((k, "\n".join(x for x in text.split("\n") if not (on(x) >= 2 and on(x) / len(pages) > 0.1))))
    assert sorted((r.doc_id, r.text) for r in got) == sorted(want)


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "x one two y"), (2, "one x two"), (3, "three"), (3, "one two"), (None, "one, TWO"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two"), (2, "three"), (3, ""), (4, None), (5, "a b c d e f g h i j k"), (5, "one")], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id) for r in decontamination.contained(docs, items).collect()))
    assert got == [(0, 1), (1, 1), (3, 1), (3, 2)]
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(docs, items).collect()) == [2, 5]


def test_no_contained_pair_is_lost(spark):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice(string.ascii_lowercase[:12]) for _ in range(rng.randint(1, 40)))) for k in range(60)]
    docs = []
    for k in range(150):
        words = items[k % 60][1].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice("yz")
        docs.append((k, " ".join([*rng.choices(string.ascii_lowercase, k=rng.randint(0, 30)), *words, *rng.choices(string.ascii_lowercase, k=10)])))
    runs = lambda t, n: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    want = set()
    for k, t in items:
        n = min(5, len(t.split()))
        own = runs(t.split(), n)
        want |= {(d, k) for d, text in docs if len(own & runs(text.split(), n)) >= 0.8 * len(own)}
    got = decontamination.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and want


def test_long_unspaced_text(spark):
    path = queries.vocabulary("piece_bpe_32k.model")
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.codec(path)
    rng = random.Random(7)
    text = "".join(rng.choice("etaoinshrdlucmfwypvbgkqjxz") for _ in range(1_000_000))
    odd = "".join(rng.choice("ab日😀, \n") for _ in range(600_000))
    began = time.time()
    ids, counts = codec.encode([text, odd, "x"])
    assert time.time() - began < 60
    assert ids.tolist() == [i for t in (text, odd, "x") for i in sp.encode(t)] and counts.sum() == len(ids)


def test_very_long_texts(spark):
    rng = random.Random(9)
    long = " ".join(f"v{rng.randrange(3000)}" for _ in range(60_000))
    near = " ".join(w if k % 900 else "other" for k, w in enumerate(long.split()))
    docs = spark.createDataFrame([(1, long, "s", "en"), (2, near, "s", "en"), (3, "short", "s", "en"), (4, long, "s", None)], "doc_id long, text string, source string, lang string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(docs).collect()} == {1: (1, 2), 2: (1, 2), 3: (3, 0), 4: (1, 2)}
    items = spark.createDataFrame([(1, " ".join(long.split()[30_000:30_040]))], "item_id long, text string")
    assert {r.doc_id for r in decontamination.contained(docs, items).collect()} >= {1, 4}
    assert line_dedup.drop_boilerplate(docs.where("doc_id < 4")).where(F.char_length("text") > 100_000).count() == 2
    path = queries.vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    n = len(tok.encode(long, add_special_tokens=False).ids)
    assert {r.n_tokens for r in vbyte.write_and_read(docs.where("doc_id IN (1, 4)"), path).collect()} == {n + 1}
    assert {r.n_tokens for r in token_counts.write_and_count(docs.where("doc_id IN (1, 4)"), path, 50256).collect()} == {n}
    assert language_id.predict(docs, language_id.fit(table(spark, SF, "documents"))).count() == 4
    assert toxicity.score(docs, queries.toxicity_model(spark, SF)).count() == 4


def test_fast_encoder_gives_the_named_library_s_ids():
    path = queries.vocabulary("byte_bpe_50k.json")
    enc, tok = byte_bpe.Encoder(path, False), Tokenizer.from_file(path)
    points = [c for c in map(chr, range(1, 0x3000)) if not 0xD800 <= ord(c) < 0xE000] + [chr(k) for k in range(0x1F300, 0x1F700)]
    for shape in ("{}", " {}", "a{}b", "{} ", "  {}  x", "'{}1"):
        text = "".join(shape.format(c) for c in points)
        assert enc.encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_counts_of_null_ids_and_repeated_rows(spark):
    path = queries.vocabulary("byte_bpe_50k.json")
    rows = [(1, "one two"), (1, "one two"), (1, "other"), (None, "three four five"), (None, None), (2, "")]
    tok = Tokenizer.from_file(path)
    want = sorted((str(k), len(tok.encode(t or "", add_special_tokens=False).ids)) for k, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = token_counts.write_and_count(docs, path, 50256, block_ids=3, listed=2).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    got = vbyte.write_and_read(docs, path, file_ids=4, block_ids=3).collect()
    assert sorted((str(r.doc_id), r.n_tokens - 1) for r in got) == want
    ends = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:])) and ends[0][0] == 0


def test_nearest_on_the_embeddings_and_odd_vectors(spark):
    sf = "/root/testdata/sf0.1"
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got, hits, want = queries.op2_nearest(spark, sf).collect(), 0, 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, *_ in mine] == list(range(1, 21)) and all(abs(s[ids == v][0] - y) < 1e-9 for _, v, y in mine)
        assert [(-y, v) for _, v, y in mine] == sorted((-y, v) for _, v, y in mine)
        hits, want = hits + len({v for _, v, _ in mine} & set(ids[np.argsort(-s)[:20]])), want + 20
    assert hits >= 0.9 * want
    index = nearest.Ranges(ids, x)
    shares = [index.search(int(ids[q]), x[q], 20)[2] / len(ids) for q in range(0, 2000, 20)]  # as the tasks do it
    assert np.mean(shares) < 0.1  # of all vectors are verified
    ties = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(30)] + [(3, [1.0, 0.0]), (40, [0.0, 0.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("v", F.lit(2))
    near = nearest.search(ties, F.col("vec_id") % 20 == 0, k=5).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in near) == [(0, k, k) for k in range(1, 6)] + [(20, k + 1, k) for k in range(5)]


@pytest.mark.parametrize("length", [100.0, 1000.0, 1e38])
def test_nearest_beside_long_vectors(spark, length):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(5_000, 64))
    x[77] *= length
    if length == 1e38:
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
        x[78], x[79] = 2e38, -2e38
    ids = np.arange(5_000)
    index, hits, shares = nearest.Ranges(ids, x), 0, []
    for q in range(0, 5_000, 50):
        found, scores, verified = index.search(q, x[q], 20)
        s = x @ x[q]
        s[q] = -np.inf
        assert np.allclose(scores, s[found], rtol=1e-12)
        hits += len(set(found.tolist()) & set(np.argsort(-s, kind="stable")[:20].tolist()))
        shares.append(verified / 5_000)
    assert hits >= 0.9 * 20 * 100 and np.mean(shares) < 0.1
    if length == 1e38:
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x[:400])], "vec_id long, embedding array<float>")
        got = nearest.search(df, F.col("vec_id") % 20 == 0, k=3).where("query_id = 60").orderBy("rank").collect()
        want = np.argsort(-np.where(np.arange(400) == 60, -np.inf, x[:400] @ x[60]), kind="stable")[:3].tolist()
        assert len(got) == 3 and got[0].vec_id == want[0] == 79


def test_windows_count_collisions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8))
    index = nearest.Index(np.arange(900), x, np.linalg.norm(x, axis=1))
    share = np.linalg.norm(x, axis=1) / index.norm
    projected = (np.column_stack((x / index.norm, np.sqrt(1 - share * share))) @ index.directions).astype(np.float32)
    own = (x[0] / np.linalg.norm(x[0]) @ index.directions[:-1]).astype(np.float32)
    last = None
    for radius in (0.01, 0.3, 0.9, 1.5, 2.0):
        windows = index.windows(own, radius)
        half = np.float32(nearest.HALF_WIDTH * radius)
        want = ((projected >= own - half) & (projected <= own + half)).sum(axis=1)
        assert index.collisions(windows).tolist() == want.tolist()
        if last:
            assert (index.collisions(last) + index.entered(last, windows)).tolist() == want.tolist()
        last = windows


def test_long_runs_of_white_space(spark):
    path = queries.vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = [" " * 2_000_000 + "x", "\n" * 2_000_000 + "x", "\t" * 2_000_000, "a" + "".join(rng.choice(" \n\t\r\u3000") for _ in range(1_500_000)) + "b", (" " * 19_999 + "x") * 3, "plain text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ids = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [byte_bpe.encoder(path).encode(t).tolist() for t in texts] == ids
    want = {k: (len(i) + 1, zlib.crc32(np.array([*i, 0], "<u4").tobytes())) for k, i in enumerate(ids)}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in vbyte.write_and_read(docs, path).collect()} == want
    assert {r.doc_id: r.n_tokens for r in token_counts.write_and_count(docs, path, 50256).collect()} == {k: len(i) for k, i in enumerate(ids)}


def test_warc_edges(spark, tmp_path):
    schema = "page_id long, url string, html string, payload string, record_type string, original long"
    none = spark.createDataFrame([], schema)
    assert warc.round_trip(none, scratch(spark, "warc-none")).count() == 0
    html = "y" * 2000
    pages = spark.createDataFrame([(1, "u", html, "p", "t", 1), (2, "u", html, "p", "t", 1), (3, None, "z", "p", "t", 1)], schema)
    path = scratch(spark, "warc-edges")
    got = warc.round_trip(pages, path).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "revisit", 2), (2, "response", None), (3, "response", None)]
    reader = warc.WarcReader({"path": path, "payload": "false"})
    taken = []

    class Watched(io.BufferedReader):
        def read(self, *n):
            taken.append(n)
            return super().read(*n)

    for part in reader.partitions():
        for file in part.paths:
            with warc.opened(path)[0].open_input_file(file) as raw:
                list(reader.records(Watched(raw)))
    assert not taken  # no payload is read
    plan = warc.read(spark, path, payload=False).where("record_type = 'revisit'")
    assert plan.count() == 1


def test_language_scores_equal_a_plain_loop(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    texts = {r.doc_id: r.text for r in docs.limit(60).collect()} | {-1: "a", -2: "...", -3: "", -4: None, -5: "Ä ß 1"}
    got = language_id.predict(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model)
    for r in got.collect():
        text = texts[r.doc_id] or ""
        if not regex.search(r"\p{L}", text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total, n = np.zeros(len(model.labels)), 0
        for word in text.split():
            h, _ = ngrams([word], language_id.SIZES, language_id.BUCKETS)
            total, n = total + model.weights[h].astype(float).sum(axis=0), n + len(h)
        p = model.probabilities((total / n + model.bias)[None])[0]
        assert r.lang_pred == model.labels[int(p.argmax())] and abs(r.score - p.max()) < 1e-4


def test_toxicity_scores_equal_a_plain_loop(spark):
    model = queries.toxicity_model(spark, SF)
    texts = [r.text for r in table(spark, SF, "documents").limit(40).collect()] + ["", None, "one", "one two"]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(texts):
        vectors, groups = [], model.prior.astype(float).copy()
        for word in (text or "").split():
            h, _ = ngrams([word], toxicity.SIZES, toxicity.BUCKETS, whole=True)
            vectors.append(model.embeddings[h].sum(axis=0) / np.sqrt(max(len(h), 1)))
            groups += model.groups[h].sum(axis=0) / max(len(h), 1)
        logit = model.bias
        for i, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = 0.0
                for at in range(len(vectors)):
                    reached = vectors[at : at + width]
                    best = max(best, sum(v @ model.filters[i][o][:, f] for o, v in enumerate(reached)) + model.offsets[i][f])
                logit += best * model.out[i * toxicity.FILTERS + f]
        score = model.scores(np.array([logit]), np.array([groups.argmax()]))[0]
        assert abs(got[k].score - score) < 1e-3 and got[k].predicted == int(got[k].score >= 0.7)


def test_ties_between_languages():
    model = language_id.Model(["aa", "bb"], np.zeros((language_id.BUCKETS, 2), np.float32), np.zeros(2))
    assert model.labels[int(model.probabilities(np.zeros((1, 2)))[0].argmax())] == "aa"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    assert sentencepiece_bpe.digests(none, queries.vocabulary("piece_bpe_32k.model")).count() == 0
    assert language_id.fit(none).labels == [] and toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert toxicity.score(none, None).count() == 0
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontamination.contained(none, items).count() == 0 and decontamination.contained(none.union(spark.createDataFrame([(1, "a b c", "s", "en")], none.schema)), items.limit(0)).count() == 0


def test_batches_stay_bounded(spark):
    docs = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("x"), 10_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], names=["n"])

    assert bounded_batches(docs).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 9 << 20


def test_recall_of_the_join_by_similarity(spark):
    """Pairs planted at similarities of 0.8 to 0.95: all that brute force links are found."""
    rng = random.Random(11)
    docs, want = [], 0
    for k in range(300):
        words = [f"t{k}x{j}" for j in range(200)]
        other = words[:]
        for at in rng.sample(range(0, 195, 6), rng.randint(1, 4)):
            other[at] = "changed"
        runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        want += len(runs(words) & runs(other)) / len(runs(words) | runs(other)) >= 0.8
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got.where("n_links > 0").count() >= 2 * want - 2 and got.where("n_links > 0").count() <= 2 * want
    assert public_tokenizers.path("piece_bpe_32k.model")
