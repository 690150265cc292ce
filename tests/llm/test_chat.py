import hashlib
import random

from codeweave.llm import chat


def slow(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), len(a := "".join(x for r, x in t if r == "assistant")), sha(a)) for c, t in out.items()}


def rows():
    rng = random.Random(5)
    bits = ["word ", "### ", "</turn>", "\\", "\\b", "\\h", "\n", "é☃🎉 ", "### Assistant: ", "#", "</turn", ">\n", ": "]
    out = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (None, 1, "assistant", "a"), (3, None, None, None), (3, 1, "we:ird: ###", ""), (3, 1, "we:ird: ###", ""), (4, 0, "system", "only")]
    for c in range(10, 40):
        for t in range(rng.randint(1, 60 if c % 10 == 0 else 8)):
            role = "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "system"])
            out.append((c, t, role, "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 30, 200])))))
    out += [(99, t, "assistant", "") for t in range(40)]
    return out


def test_round_trip_and_budget(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "x") for r in data], "conv_id long, turn long, role string, text string, block string")
    for budget, history, turns in ((1024, 192, 2), (120, 40, 3), (60, 0, 0)):
        windows = chat.format_windows(df, budget, history, turns).cache()
        got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(windows).collect()}
        assert got == slow(data)
        for w in windows.collect():
            blocks = w.text.split("</turn>\n")[:-1]
            assert w.over_budget == (w.n_tokens > budget)
            system = w.window == 0 and blocks[0].startswith("### system: ")
            assert not w.over_budget or len(blocks) - w.n_repeated - system <= 1
    spans = windows.where("conv_id = 4").first()
    assert spans.text == "### system: only</turn>\n" and spans.loss_spans == []


def test_system_and_history_are_repeated_and_masked(spark):
    data = [(1, 0, "system", "be kind")] + [(1, t, "user" if t % 2 else "assistant", f"turn {t} " + "x " * 30) for t in range(1, 9)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(df, 150, 50, 1).orderBy("window").collect()
    assert len(windows) > 2
    for w in windows[1:]:
        assert w.text.startswith("### system: be kind</turn>\n") and w.n_repeated == 2
    loss = [w.text[s.start : s.start + s.length] for w in windows for s in w.loss_spans]
    assert loss == [t for _, _, r, t in data if r == "assistant"]


def test_empty_and_native(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(df)
    assert chat.digests(windows).count() == 0
    plan = chat.digests(windows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
