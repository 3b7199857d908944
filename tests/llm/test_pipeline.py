"""Every stage of the pipeline against plain loops over what the stage before left."""

import hashlib

import pyarrow as pa
import regex
import sentencepiece

import corpus_pipeline as p
from gapweave.llm import decontamination, line_dedup, queries, toxicity
from gapweave.llm.common import materialise, table

SF = "/root/testdata/sf0.001"


def words(text):
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def runs(tokens, n):
    return {tuple(tokens[k : k + n]) for k in range(len(tokens) - n + 1)}


def shingles(text):
    w = words(text)
    return runs(w, min(5, len(w))) if w else set()


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, [r.asDict() for r in docs.collect()]
    kept = {}
    for name, stage in p.STAGES:
        docs = materialise(stage(spark, docs, SF), "stage")
        kept[name] = [r.asDict() for r in docs.collect()]
        assert name == p.STAGES[-1][0] or docs.columns == columns
    key = lambda rows: sorted((r["doc_id"], r["text"] or "") for r in rows)

    model = queries.toxicity_model(spark, SF)
    scores = toxicity.scores_of(model, toxicity.word_memo(model), pa.array([r["text"] for r in before], pa.string()))
    assert key(kept["toxicity"]) == key([r for r, s in zip(before, scores, strict=True) if s < toxicity.CUT])

    pages = {}
    for r in kept["toxicity"]:
        pages.setdefault(r["source"], []).append({x.strip(" ") for x in (r["text"] or "").split("\n")} - {""})
    clean = []
    for r in kept["toxicity"]:
        own = pages[r["source"]]
        often = lambda line: (n := sum(line.strip(" ") in page for page in own)) >= line_dedup.REPEATED and n / len(own) > line_dedup.RATIO  # noqa: B023, E731
        text = None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if not often(x))
        clean.append({"doc_id": r["doc_id"], "text": text})
    assert key(kept["line dedup"]) == key(clean)
    assert all(r["n_chars"] == len(r["text"]) for r in kept["line dedup"] if r["text"] is not None)

    rows = sorted(kept["line dedup"], key=lambda r: r["doc_id"])
    sets = [shingles(r["text"]) for r in rows]
    root = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if sets[a] & sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    assert key(kept["n-gram Jaccard join"]) == key([r for k, r in enumerate(rows) if root[k] == k])

    items = [words(r.text) for r in table(spark, SF, "benchmark").collect()]
    items = [(min(5, len(w)), runs(w, min(5, len(w)))) for w in items if w]
    holds = lambda text: any(len(s & runs(words(text), n)) >= decontamination.SIMILARITY * len(s) - 1e-9 for n, s in items)
    assert key(kept["benchmark decontamination"]) == key([r for r in kept["n-gram Jaccard join"] if not holds(r["text"])])
    assert len(kept["benchmark decontamination"]) < len(kept["n-gram Jaccard join"])

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    want = []
    for r in kept["benchmark decontamination"]:
        ids = sp.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in kept["SentencePiece"]) == sorted(want)
    assert sorted(map(str, p.run(spark, SF).collect())) == sorted(map(str, docs.collect()))


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_pipeline_without_labels_and_items(spark, tmp_path):
    import corpus_pipeline as p

    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    rows = [(1, "a b c d e f g", "en", "s", 13), (2, None, None, "s", 0), (3, "", "en", None, 0), (1, "a b c d e f g", "en", "u", 13), (4, "a b c d e f g", "en", "t", 13)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id, r.n_tokens > 0) for r in p.run(spark, str(tmp_path)).collect()) == [(1, True), (1, True), (2, False), (3, False)]
