"""The SQL statements against the operators, on awkward texts."""

import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402
from test_centroid_clusters import vectors  # noqa: E402
from test_rules import secret_texts, texts  # noqa: E402

from transitlapse.llm.oracles import ORACLES  # noqa: E402
from transitlapse.llm.queries import QUERIES  # noqa: E402


def test_same_rows(spark, tmp_path):
    all_texts = [*texts(), *secret_texts()]
    cases.docs(spark, all_texts).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(i, t) for i, t in enumerate([all_texts[-40], "word word word", "two spaces", None, "x", " ".join(all_texts[60].split()[2:15])])]
    spark.createDataFrame(items, "item_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    some = [*vectors(120, 8), (900, None), (901, [0.5] * 63), (902, [0.5] * 63 + [None]), (903, [float("nan")] + [0.0] * 63), (5, [-0.5] * 64)]
    spark.createDataFrame(some, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, str(tmp_path))
        cur = con.execute(sql)
        at = [d[0] for d in cur.description]
        want = sorted(repr(tuple(r[at.index(c)] for c in df.columns)) for r in cur.fetchall())
        assert sorted(at) == sorted(df.columns)
        assert sorted(repr(tuple(r)) for r in df.collect()) == want, name
