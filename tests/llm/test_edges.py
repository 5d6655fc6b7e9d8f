"""Every operator: nulls, empty and very long texts, ties and repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from lanternfish.llm import bpe, decontam, lines, nbsvm, neardup, pii, pst, rules, simhash, toxicity, warc
from lanternfish.llm.queries import TOKENIZERS

PATH = f"{TOKENIZERS}/byte_bpe_50k.json"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, ids string, removed int, text_hash int, n_words int"
LONG = "word " * 40_000 + "x" * 70_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "A line of words that is here twice.\nA line of words that is here twice."), (6, "tie tie tie"), (6, "tie tie tie"), (None, "no id here at all, but words."), (7, "ünï çödé 中文 😀"), (8, None)]
    return spark.createDataFrame([(i, t, None, "s", 1, 0.5, 1, "x", 1, 1, 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 1), (5, 0, 0), (6, 1, 1), (6, 0, 0), (None, 1, 1), (7, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "tie tie"), (None, "Words that is")], "item_id long, text string")


OPERATORS = {
    "lines": lambda d, l, b: lines.dedup(d),
    "bpe": lambda d, l, b: bpe.encode_documents(d, PATH, decoded=True),
    "decontam": lambda d, l, b: decontam.match(d, b),
    "decontaminate": lambda d, l, b: decontam.decontaminate(d, b, max_coverage=1.0),
    "pst": lambda d, l, b: pst.score(d),
    "rules": lambda d, l, b: rules.judge(d, l),
    "toxicity": lambda d, l, b: toxicity.classify(d, l),
    "simhash": lambda d, l, b: simhash.near_duplicates(d),
    "nbsvm": lambda d, l, b: nbsvm.classify(d, l),
    "pii": lambda d, l, b: pii.find(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_a_document(name, docs, labels, benchmark):
    assert OPERATORS[name](docs, labels, benchmark).count() == docs.count()


@pytest.mark.parametrize("name", [*OPERATORS, "neardup"])
def test_empty_tables(name, docs, labels, benchmark):
    got = {"neardup": lambda d, l, b: neardup.dedup(d), **OPERATORS}[name](docs.limit(0), labels.limit(0), benchmark.limit(0))
    assert got.count() == 0 and len(set(got.columns)) == len(got.columns)


def test_defined_results(docs, labels, benchmark, spark):
    by = lambda df, c: {(r["doc_id"]): r[c] for r in df.collect()}
    assert by(bpe.encode_documents(docs, PATH), "n_tokens")[1] == 0
    coded = bpe.encode_documents(docs, PATH, decoded=True).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in coded)
    hit = by(decontam.match(docs, benchmark), "items")
    assert hit[6] == ["3"] and hit[5] == [""] and hit[1] == []
    assert by(simhash.near_duplicates(docs), "component_id")[8] == 1  # null, empty and blank texts are linked
    judged = rules.judge(docs, labels).collect()
    assert all(r["base_failed"] for r in judged if r["doc_id"] in (1, 2, 3)) and not any(r["kept"] for r in judged if r["base_failed"])
    assert by(lines.dedup(docs), "removed")[5] == [1]
    scores = by(pst.score(docs), "n_tokens")
    assert scores[1] == scores[2] == scores[3] == 1
    kept = neardup.dedup(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "4", "5", "6", "7", "None"]  # copies without words, and repeated rows


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b", None), (None, "u", "<p>é</p>"), (2, None, "<p>é</p>"), (4, "l", "z" * 3_000_000)], "page_id long, url string, html string")
    got = warc.archive_pages(spark, pages, payloads=True).collect()
    rows = sorted((r["metadata"]["fields"].get("capture-key", ""), r["capture"]["warc_type"], r["metadata"]["fields"].get("refers-to-key"), r["capture"]["http_length"]) for r in got)
    assert rows == [("", "revisit", "2", 9), ("1", "revisit", "2", 9), ("2", "response", None, 9), ("2", "response", None, 9), ("3", "response", None, 0), ("4", "response", None, 3_000_000)]
    assert all(r["request"] is not None for r in got) and all(r["capture"]["computed_digest"] == r["capture"]["payload_digest"] for r in got if r["capture"]["warc_type"] == "response")
    assert all(r["capture"]["payload_bytes"] == r["capture"]["http_length"] for r in got if r["capture"]["warc_type"] == "response")
    told = {r["record_id"]: r for r in warc.archive_pages(spark, pages.where("page_id is not null or url is null").dropDuplicates(), payloads=True).collect()}
    (revisit,) = (r["capture"] for r in told.values() if r["capture"]["warc_type"] == "revisit")
    assert told[revisit["refers_to"]]["metadata"]["fields"]["capture-key"] == "2" and told[revisit["refers_to"]]["capture"]["payload"].decode() == "<p>é</p>"
    assert warc.archive_pages(spark, pages.limit(0)).count() == 0
    assert {r["capture"]["warc_type"] for r in warc.archive_pages(spark, pages, min_bytes=10).collect()} == {"response"}


def test_columns_with_names_of_the_operators_own(spark):
    names = "own_doc own_hash own_sig lost row line lo hi near place node root key n size gone first doc sig text_hash _doc _sig".split()
    docs = spark.createDataFrame([(i, "one line of six words here\nand a last one", *([f"mine{i}"] * len(names))) for i in (1, 2)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = lines.dedup(docs).orderBy("doc_id").collect()
    assert [r["removed"] for r in got] == [[], [0, 1]] and all(r[c] == f"mine{r['doc_id']}" for r in got for c in names)
    (kept,) = neardup.dedup(docs).collect()
    assert kept["doc_id"] == 1 and all(kept[c] == "mine1" for c in names) and neardup.dedup(docs).columns == docs.columns


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty and repeated texts, columns beside the usual, and empty tables, through all stages."""
    import corpus_pipeline as c

    full = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "Words of a text that is here twice and says little more than that.", "en", "s", 60), (3, "Words of a text that is here twice and says little more than that.", "en", "s", 60), (None, "No number, but words enough to stay as a text of its own kind.", "en", None, 5)]
    for name, some in (("rows", rows), ("none", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(some, full).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(3, 1, 0)][: len(some)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "tie")][: len(some)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = c.run(spark, d).collect()
        assert all(r["round_trip"] for r in got) and len(got) <= len(some)
        assert sum(r["doc_id"] == 3 for r in got) <= 1 and not any(r["doc_id"] is None and not r["n_tokens"] for r in got)
