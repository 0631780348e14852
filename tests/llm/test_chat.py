import hashlib
from collections import defaultdict

from ostrakon.llm import chat
from ostrakon.llm.common import table
from ostrakon.llm.queries import ORACLE


def want(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ODD = [
    (1, 0, "system", "be <b>kind</b>"), (1, 1, "user", None), (1, 2, "assistant", "\\l\\b\\\\g<turn user>x</turn>\n"), (1, 3, None, "é" * 700),
    (1, 4, "assistant", "a b " * 300), (1, 5, "user", "c " * 90), (1, 6, "assistant", "d " * 50), (1, 7, "user", ""), (1, 7, "user", ""), (1, 8, "assistant", "end"),
    (2, None, "assistant", "x"), (2, 0, "a>s<s\\", "y"), (3, 0, "system", "only"), (4, 0, "system", "s " * 900), (4, 1, "assistant", "t " * 20), (None, 0, "user", "q"),
]


def test_reading_back_gives_the_turns(spark):
    frame = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS window", "2 AS i")
    rows = chat.digests(chat.format_windows(frame)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == want(ODD)


def test_windows(spark):
    frame = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(frame).where("conv_id = 1").orderBy("window").collect()
    assert len(windows) > 2
    seen = 0
    for w in windows:
        turns = w.text.split("</turn>\n")[:-1]
        assert turns[0].startswith("<turn system>") and all(t.startswith("<turn ") and "<" not in t[1:] for t in turns)
        assert w.tokens <= chat.BUDGET or len(turns) - w.n_repeated == 1 and w.n_repeated == 1
        assert w.n_repeated <= 1 + chat.HISTORY_TURNS
        seen += len(turns) - w.n_repeated
        for s in w.loss:
            assert w.text[: s.start].endswith("<turn assistant>") and w.text[s.start + s.length :].startswith("</turn>")
    assert seen == 10 and sum(len(w.loss) for w in windows) == 4


def test_the_oracle_agrees(spark, sf):
    import duckdb

    got = chat.digests(chat.format_windows(chat.with_trap(spark, table(spark, sf, "conversations"))))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    rows = con.execute(ORACLE["op2_chat"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert max(r.n_windows for r in got.collect()) > 1


def test_native_plan_and_empty_table(spark, sf):
    got = chat.digests(chat.format_windows(chat.with_trap(spark, table(spark, sf, "conversations"))))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert chat.digests(chat.format_windows(table(spark, sf, "conversations").limit(0))).count() == 0


def test_windows_are_full_and_keep_the_budget(spark):
    conversations = table(spark, "/root/testdata/sf0.1", "conversations")
    many = spark.range(200).selectExpr("-1L AS conv_id", "id AS turn", "if(id = 0, 'system', 'user') AS role", "repeat('w ', 1 + id % 90) AS text")
    conversations = conversations.select("conv_id", "turn", "role", "text").unionByName(many)
    for r in chat.format_windows(conversations).collect():
        fresh = r.text.split("</turn>\n")[:-1][r.n_repeated :]
        assert r.tokens <= chat.BUDGET or len([t for t in fresh if not t.startswith("<turn system>")]) == 1 and r.n_repeated <= 1
    turns = defaultdict(list)
    for r in chat.spans(conversations).collect():
        turns[r.conv_id].append(r)
    for rows in turns.values():
        rows.sort(key=lambda r: r.i)
        kept = rows[0].tokens if rows[0].role == "system" else 0
        own = defaultdict(int)
        for r in rows[bool(kept) :]:
            own[r.window] += r.tokens
        for a, b in zip(rows[bool(kept) :], rows[bool(kept) + 1 :]):
            # A turn opens a window only where the one before has no room for it.
            assert a.window == b.window or b.i % chat.BLOCK == 0 or own[a.window] + b.tokens > max(1, chat.BUDGET - chat.HISTORY_TOKENS - kept)
