"""Small tables of documents with the odd cases every operator has to stand."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def odd_documents():
    long = " ".join(f"word{i % 977} thing{i % 331}" for i in range(40_000))
    texts = [None, "", " \n\t ", "Hello, World! MIT License", "hello, world! mit license", "a", "é à ü", long, long, "x" * 50_000, "\x00\x1f odd\x85text  日本語 text", "idiot scum loser " * 3]
    return [(i, t, [None, "en", "de"][i % 3], None if i % 4 == 0 else "src0", None) for i, t in enumerate(texts)] + [(3, "Hello, World! MIT License", "en", "src0", 5)]


def frame(spark, rows=None):
    return spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA).repartition(3)


def crowded(df, *names):
    """With columns whose names clash with those of an operator's own."""
    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df
