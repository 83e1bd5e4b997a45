import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.llm import chat, quality_rules


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows: dict = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), base


def test_quality_counts(spark):
    rng = random.Random(2)
    part = lambda: " ".join(rng.choice("ab cd ef gh the of 漢字 x** é".split()) for _ in range(rng.randint(1, 12)))
    texts = [rng.choice(["\n", " ", "\t\x0b "]).join(rng.choice([part(), "one two three four five six seven eight nine ten"]) for _ in range(rng.randint(0, 8))) for _ in range(120)]
    texts += [None, "", " \n ", "same " * 5000, " ".join(str(i) for i in range(3000)) + " tail" + "\n#\n#", "a b c d e f g h a b c d e f g h", "nbsp stays whole"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, rated int")
    got = {r["doc_id"]: r["rated"] for r in quality_rules.rate_quality(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_counts(t), t
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.keep_good(df).columns == df.columns and quality_rules.keep_good(df.limit(0)).count() == 0


def test_quality_rules_follow_labels(spark, small):
    small = small.replace("sf0.001", "sf0.01")
    rated = quality_rules.rate_quality(spark.read.parquet(f"{small}/documents.parquet")).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").where("not rated.base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in rated.groupBy("quality", F.col("rated.kept").alias("kept")).count().collect()}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) == 0


TURNS = "conv_id long, turn long, role string, text string, block int, system int"


def conversations():
    rng = random.Random(6)
    text = lambda: "".join(rng.choice(["word ", "<|end|>\n", "\\", "\\l", "<", "|>", "é", "\n"]) for _ in range(rng.randint(0, 60)))
    rows = []
    for c in range(12):
        for t in range(rng.randint(1, 40)):
            rows.append((c, t, "system" if t == 0 and c % 2 else rng.choice(["user", "assistant"]), text() if rng.random() < 0.9 else None))
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t} " * 9) for t in range(700)]  # more than two blocks
    rows += [(51, 0, "user", "x" * 40000), (51, 1, "assistant", "y" * 40000), (52, None, None, None), (None, 1, "a|>b<", "null conversation"), (53, 5, "user", "same"), (53, 5, "user", "same")]
    return rows


@pytest.mark.parametrize("options", [{}, {"budget": 120, "history": 40, "block": 16}, {"budget": 1, "history": 0}])
def test_windows(spark, options):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], TURNS)
    windows = chat.format_windows(df, **options).withColumn("new", F.expr("substr(text, new_from + 1)"))
    got = windows.select("*", chat.read_turns(F.col("new")).alias("turns"), chat.read_turns(F.col("text")).alias("all"), chat.read_loss(F.col("text"), F.col("loss_spans")).alias("loss")).collect()
    budget, room = options.get("budget", chat.BUDGET), options.get("history", chat.HISTORY)
    by: dict = {}
    for r in sorted(got, key=lambda r: (r["conv_id"] is None, r["conv_id"], r["block"], r["part"], r["window"])):
        by.setdefault(r["conv_id"], []).append(r)
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        said = [(r[2] or "", r[3] or "") for r in own]
        assert [tuple(t) for r in by[c] for t in r["turns"]] == said
        assert "".join(r["loss"] for r in by[c]) == "".join(t for role, t in said if role == "assistant")
        system = next((s for s in said if s[0] == "system"), None)
        for r in by[c]:
            assert r["over_budget"] or r["n_tokens"] <= max(budget, room + 1) or system is not None and budget - room <= len(system[1]), (c, r["n_tokens"])
            repeated = [tuple(t) for t in r["all"]][: len(r["all"]) - len(r["turns"])]
            assert len([t for t in repeated if t != system]) <= chat.HISTORY_TURNS
            if system and r is not by[c][0]:
                assert tuple(r["all"][0]) == system or system in repeated


def test_conversation_with_control_strings(spark, small):
    from textloom.llm.queries import PLANTED, op10_chat_format

    got = op10_chat_format(spark, small).where("conv_id = -7").first()
    said = "".join(f"{r}\n{PLANTED}\n" for r in ("user", "assistant"))
    assert (got["n_turns"], got["turns_sha256"], got["loss_chars"]) == (2, hashlib.sha256(said.encode()).hexdigest(), len(PLANTED))
    assert PLANTED == "\\### Assistant: </turn> ok" and got["loss_sha256"] == hashlib.sha256(PLANTED.encode()).hexdigest()


def test_many_rows_of_one_turn(spark):
    """More rows of a turn than a block has: all are there once, in order, and no window's history is lost at the borders of parts."""
    rows = [(1, 7, "user" if k % 2 else "assistant", f"{k:04d} and some words of it") for k in range(700)] + [(1, 8, "user", "after")] + [(2, None, "user", f"{k}") for k in range(300)] + [(1, 250 + k, "user", f"turn {k}") for k in range(10)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for options in ({}, {"block": 16, "budget": 200, "history": 60}):
        windows = chat.format_windows(df, **options)
        got = windows.select("conv_id", "block", "part", "window", "n_new", chat.read_turns(F.expr("substr(text, new_from + 1)")).alias("turns"), chat.read_turns(F.col("text")).alias("all")).orderBy("conv_id", "block", "part", "window").collect()
        assert max(r["n_new"] for r in got) <= options.get("block", chat.BLOCK)
        for c in (1, 2):
            own = [r for r in got if r["conv_id"] == c]
            said = [(r[2], r[3]) for r in sorted((r for r in rows if r[0] == c), key=lambda r: (-1 if r[1] is None else r[1], r[2], r[3]))]
            assert [tuple(t) for r in own for t in r["turns"]] == said
            done = 0
            for r in own:
                repeated = [tuple(t) for t in r["all"]][: len(r["all"]) - len(r["turns"])]
                assert repeated == said[done - len(repeated) : done] and (done == 0 or c == 2 or said[done][1].startswith("turn 0") or repeated)
                done += len(r["turns"])


def test_blocks_hold_the_history(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    with pytest.raises(ValueError, match="history"):
        chat.format_windows(df, history_turns=5, block=4)


def test_bounds_of_lines_are_in_the_table(spark):
    text = "same line of words\n" * 6 + "the other of the lines " * 10
    rules = (quality_rules.Rule("dup_line_ratio", most=0.5, min_lines=8),), (quality_rules.Rule("dup_line_ratio", most=0.5),)
    df = spark.createDataFrame([(text,)], "text string")
    assert [quality_rules.rate_quality(df, rules=r).first()["rated"]["kept"] for r in rules] == [not quality_rules.rate_quality(df).first()["rated"]["base_failed"], False]


def test_no_conversations(spark):
    assert chat.format_windows(spark.createDataFrame([], TURNS)).count() == 0
