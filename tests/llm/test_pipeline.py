"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_components, words


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _name string, gap int"


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", None if t is None else len(t), "x", 1) for i, t in pairs], COLUMNS)


def test_near_copies_are_rows_not_ids(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b, c = a.replace("a", "b"), a.replace("a", "c")
    near = a.replace("a59", "z")
    pairs = [(1, a), (3, a), (3, b), (5, c), (5, c), (None, near), (None, "x y z"), (None, "x y z"), (7, None), (7, None), (8, " "), (9, "X  y\tz")]
    out = corpus_pipeline.one_of_near_copies(spark, docs_of(spark, pairs), "")
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (3, b), (5, c), (7, None), (7, None), (8, " "), (9, "X  y\tz")], key=str)
    assert out.columns == docs_of(spark, pairs).columns


def test_stages_on_odd_tables(spark, sf, tmp_path):
    """No rows; null ids, repeats, ties, a very long text, clashing names: each stage keeps what it should."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    long_text = " ".join(f"w{i}" for i in range(200_000))
    odd = [(1, long_text), (1, long_text), (None, "plain words stay here"), (2, None), (2, ""), (3, "same text of this document"), (4, "same text of this document"), (5, "line one that is long enough\nx"), (6, "line one that is long enough\ny"), (7, "line one that is long enough\nz")]
    for pairs in ([], odd):
        docs = docs_of(spark, pairs)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            rows = out.collect()
            if name != "packing":
                assert out.columns == docs.columns
                docs = spark.createDataFrame(rows, docs.schema)
            if name in ("quality_classifier", "line_dedup"):
                assert len(rows) == len(pairs)
            if name == "line_dedup" and pairs:
                assert sorted(r.text for r in rows if r.doc_id in (5, 6, 7)) == ["line one that is long enough\nz", "x", "y"]
            if name == "ngram_jaccard_join" and pairs:
                assert Counter(r.doc_id for r in rows) == Counter([1, None, 2, 2, 3, 5, 6, 7])
            if name == "source_mixing":
                assert {str(r.doc_id) for r in rows} == ({"1", "None", "2", "3", "5", "6", "7"} if pairs else set())
        assert len(rows) == docs.count()


def test_run_is_its_stages(spark, sf):
    """run() against the stages one by one, each on what the one before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
    assert Counter(map(str, docs.collect())) == Counter(map(str, corpus_pipeline.run(spark, sf).collect()))


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"keep": F.lit(1), "node": F.lit("x")})
    extra = docs.limit(2).withColumns({"doc_id": F.lit(10**9) + F.col("doc_id"), "text": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})
    docs = docs.unionByName(extra)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, sf)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns and dict(out.dtypes)["n_chars"] == "bigint"
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs.collect())

    before, after = kept["quality_classifier"]
    ids = {r.doc_id for r in after}
    known = [i for i, _ in before if i in labels]
    assert sum((i in ids) == (labels[i] == 1) for i in known) >= 0.97 * len(known)

    before, after = kept["line_dedup"]
    where = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for doc, text in before:
        for line in (text or "").split("\n"):
            where.setdefault(key(line), set()).add(doc)
    gone = lambda doc, line: len(key(line)) >= 20 and len(where[key(line)]) >= 3 and max(where[key(line)]) != doc
    want = {doc: None if text is None else "\n".join(x for x in text.split("\n") if not gone(doc, x)) for doc, text in before}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)

    before, after = kept["ngram_jaccard_join"]
    label = {doc: component for doc, _, component in brute_components(before, 5, 80, 100)}
    assert sorted(r.doc_id for r in after) == sorted(doc for doc, component in label.items() if doc == component or not words(dict(before)[doc]))

    before, after = kept["source_mixing"]
    copies = Counter(r.doc_id for r in after)
    assert set(copies) == {doc for doc, _ in before} and set(copies.values()) <= {1, 2}

    before, after = kept["packing"]
    assert Counter((r.doc_id, r.n_tokens) for r in after) == Counter((doc, len(words(text))) for doc, text in before)
