"""Small tables with every awkward kind of row."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])
#: Columns whose names clash with those that operators add.
CLASH = T.StructType([*SCHEMA.fields, T.StructField("n_words", T.StringType()), T.StructField("score", T.StringType()),
                      T.StructField("spans", T.StringType()), T.StructField("class_id", T.StringType()),
                      T.StructField("items", T.StringType()), T.StructField("ids", T.StringType())])


def docs(spark, texts, ids=None, schema=SCHEMA):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", "s", None if t is None else len(t), *["x"] * (len(schema) - 5)) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, schema)


ODD = [None, "", " ", "\n", "a", "  two  spaces ", "tab\tand\nline\r\nend\n", "é ü 日本語 テキスト 😀", "don't. Stop, now;",
       "same text twice, word for word", "same text twice, word for word", "x" * 3000, "word " * 2000, "<|endoftext|> here",
       "　wide　space   nbsp", "AKIA", "1 2 3\n\n\n4"]
