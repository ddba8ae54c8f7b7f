"""The five stages on a table with a case for each of them."""

import random

from test_operators import WORDS, documents, near

import corpus_pipeline as cp


def clean(seed, n=120):
    r = random.Random(seed)
    return "\n".join(" ".join(r.choices(WORDS, k=12)).capitalize() + "." for _ in range(n // 12))


def test_stages(spark, tmp_path):
    good = {i: clean(i) for i in range(40)}
    rows = [(i, x, f"s{i % 4}") for i, x in good.items()]
    rows += [(50, good[3] + "  ", "s1"), (51, good[4].replace("\n", " \n"), "s2"), (52, near(good[5], 1, 6), "s0"), (53, None, "s0"), (54, "too short", None), (55, "a | b * " * 80, "s2"), (56, "same words here " * 60, "s3")]
    docs = documents(spark, rows)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    now, seen = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), []
    for _, stage in cp.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns
        seen.append(sorted(r["doc_id"] for r in now.collect()))
    assert seen[0] == [*range(40), 50, 51, 52]
    assert seen[1] == sorted({*range(40), 50, 51, 52} - {3, 4})  # the longer text of equal ones stays
    assert seen[2] == sorted(set(seen[1]) - {52})
    assert set(seen[3]) <= set(seen[2]) and max(seen[3].count(i) for i in seen[3]) <= 3
    out = cp.run(spark, f"file://{tmp_path}").collect()
    assert sorted(r["doc_id"] for r in out) == seen[3]
    text = {r[0]: r[1] for r in rows}
    assert all(r["decoded"] == text[r["doc_id"]] for r in out)
