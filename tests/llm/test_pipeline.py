import random

from molecast.llm.common import table

from .helpers import docs, words


def test_stages_on_planted_cases(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(6)
    item = words(rng, 30)
    rows = [(i, " ".join(words(rng, 80))) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(5)]  # copies
    rows += [(300 + i, rows[i][1] + " tail") for i in range(5)]  # near copies
    rows += [(400 + i, " ".join(words(rng, 40) + item + words(rng, 40))) for i in range(5)]  # leaks
    rows += [(500 + i, " ".join([*words(rng, 40), "grumble", *words(rng, 20)])) for i in range(40)]  # toxic
    rows += [(600, None), (601, "")]
    rows += [(700 + i, f"BAD% {i}% " + f"BAD% LINE{i}% " * 40) for i in range(30)]  # of low quality
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 700), int(500 <= i < 600)) for i in (*range(0, 120, 2), *range(500, 540, 2), *range(700, 730, 2))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, held = table(spark, str(tmp_path), "documents"), {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k + 1 < len(P.STAGES):
            assert out.schema == at.schema, name
        out.write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        held[k] = {r.doc_id for r in at.select("doc_id").collect()}
    clean = set(range(120)) | {600, 601}
    assert not {i for i in held[0] if 500 <= i < 600} and clean <= held[0]
    assert held[1] == held[0] - {200 + i for i in range(5)} - {300 + i for i in range(5)}
    assert held[2] == held[1] - {400 + i for i in range(5)}
    assert clean - {600, 601} <= held[3]
    assert held[4] == held[3]
    whole = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in whole} == held[4] and {r.law for r in whole} == {"bytes"}


def test_near_copies_go_by_row(spark):
    import corpus_pipeline as P

    rng = random.Random(7)
    base = [" ".join(words(rng, 80)) for _ in range(9)]
    rows = [(1, base[0]), (None, base[0] + " tail"), (None, base[1]), (None, base[2])]  # a null id has a copy, others haven't
    rows += [(2, base[3]), (2, base[4]), (1, base[4] + " tail")]  # one of an id's two texts has a copy
    rows += [(3, base[5])] * 3 + [(None, base[6])] * 4 + [(None, base[7]), (None, base[7] + " tail")] + [(4, None), (4, None), (None, ""), (5, base[8])]
    left = sorted(((r.doc_id, r.text) for r in P.near_copies(spark, docs(spark, rows), "").collect()), key=repr)
    sevens = [x for x in left if x[1] and x[1].startswith(base[7])]
    assert len(sevens) == 1
    assert [x for x in left if x not in sevens] == sorted([(1, base[0]), (None, base[1]), (None, base[2]), (2, base[3]), (1, base[4] + " tail"), (3, base[5]), (None, base[6]), (4, None), (4, None), (None, ""), (5, base[8])], key=repr)
