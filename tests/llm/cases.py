"""Small tables with awkward rows."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "llm_id string, LLM_hash string, llm_cut string, llm_rate string, llm_aim string, llm_draw string, k_hash string, k_id string, fp string, starts string, wanted string, label string, h string, row string"

LINE = "the quick brown fox jumps over the lazy dog and runs away from it"
BLOCK = "".join(f"line {i} of a block of text\n" for i in range(30))
PASSAGE = " ".join(f"shared{i}" for i in range(70))


def edge_rows():
    """Nulls, empty and blank texts, ties, repeated rows, copies, very long texts."""
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \n\t ", None, "b", 4),
        (4, "one two", "en", None, 7),
        (5, LINE, "en", "b", len(LINE)),
        (5, LINE, "en", "b", len(LINE)),
        (6, LINE + ".", "en", "b", len(LINE) + 1),
        (7, PASSAGE + " tail of seven", "en", "a", None),
        (8, "head of eight " + PASSAGE, "en", "c", 9),
        (9, BLOCK + f"{LINE}\n{LINE} again\nthird line\n" * 3, "en", "c", 9),
        (10, "own start\n" + BLOCK + "own end", "en", "c", 9),
        (11, "ab " * 400, "en", "a", 1200),
        (12, "é€😀 " * 200, "fr", "a", 600),
        (13, "A" * 5000, "en", "c", 5000),
        (None, "no id at all", "en", "c", 12),
        (None, PASSAGE, "de", "c", 12),
        (14, " ".join(f"w{i % 977}x{i}" for i in range(40000)), "en", "a", 1),
        (15, "Mail bob@mail.example.com or +1 (017) 555-7713, from 10.0.0.1 with 4539578763621486.", "en", "b", 1),
    ]
    return rows


def docs(spark, rows=None, clash=True):
    rows = edge_rows() if rows is None else rows
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        from pyspark.sql import functions as F

        names = [c.split()[0] for c in CLASH.split(", ")]
        df = df.select("*", *[F.lit("x").alias(n) for n in names])
    return df.repartition(3)


def empty(spark):
    return docs(spark, [])


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def mixed(spark):
    """The given documents with the awkward rows on top."""
    more = [(r[0] + 10**6 if r[0] is not None else None, *r[1:]) for r in edge_rows()]
    return table(spark, "documents").unionByName(docs(spark, more, clash=False))


def rows_of(df, *columns):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
