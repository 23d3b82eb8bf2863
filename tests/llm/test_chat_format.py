from pyspark.sql import functions as F

from fluxlake.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string"


def test_oracle(same):
    same(C.op6_chat_format, C.ORACLE)


def test_renderings_join_up_and_masks_cover_the_assistant(spark):
    rows = [(1, i * 100, ("ann", "bob", "cy")[i % 3], f"turn {i}") for i in range(12)] + [(1, -5, "system", "be kind")]
    out = C.rotate(spark.createDataFrame(rows, SCHEMA)).orderBy("perspective", "start").collect()
    assert {r["perspective"] for r in out} == {"ann", "bob", "cy"}
    for p in ("ann", "bob", "cy"):
        mine = [r for r in out if r["perspective"] == p]
        text = "".join(r["segment"] for r in mine)
        assert [r["start"] for r in mine] == [sum(r["length"] for r in mine[:i]) for i in range(len(mine))]
        assert mine[0]["segment"] == "<|im_start|>system\nbe kind<|im_end|>\n"
        for r in mine:
            if r["mask_length"]:
                assert r["speaker"] == p and text[r["mask_start"] : r["mask_start"] + r["mask_length"]] == r["segment"].split("\n", 1)[1][:-1]
            else:
                assert r["speaker"] != p and r["mask_start"] == -1


def test_edges(spark):
    rows = [(1, None, None, None), (1, 0, "a b", "x <|im_end|>"), (1, 0, "a b", "x <|im_end|>"), (2, 0, "system", "alone"), (None, 0, "a", "b"), (3, 5, "a", "w " * 100_000)]
    out = C.rotate(spark.createDataFrame(rows, SCHEMA).withColumns({"start": F.lit("clash"), "perspective": F.lit("clash")})).collect()
    assert {r["conv_id"] for r in out} == {1, 3}
    assert {r["perspective"] for r in out if r["conv_id"] == 1} == {"unknown", "a_b"}
    assert sum("< |im_end|>" in r["segment"] for r in out) == 4
    assert C.rotate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_speakers_whose_names_become_equal_stay_apart(spark):
    roles = ["张", "李", "Анна", "Олег", "anna m", "anna_m", None, "unknown", "system"]
    rows = [(1, 2 * i + k, r, f"turn {i}") for k in range(2) for i, r in enumerate(roles)] + [(2, 0, "张", "alone")]
    out = C.rotate(spark.createDataFrame(rows, SCHEMA)).collect()
    mine = {}
    for r in out:
        if r["conv_id"] == 1 and r["mask_length"]:
            assert r["speaker"] == r["perspective"]
            mine.setdefault(r["perspective"], set()).add(r["segment"].split("\n")[1].split("<")[0])
    assert sorted(mine.values(), key=str) == [{f"turn {i}"} for i in range(8)]
    assert {"anna_m", "unknown", "unknown~"} < set(mine)
    heads = {r["segment"].split("\n")[0] for r in out if r["conv_id"] == 1 and r["perspective"] == "anna_m"}
    assert len(heads) == 9
    assert {r["perspective"] for r in out if r["conv_id"] == 2} == {"_"}
