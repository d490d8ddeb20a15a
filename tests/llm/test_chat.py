import hashlib
import random
from collections import defaultdict

from leafmill.llm import queries, sql
from leafmill.llm.chat_quotes import link_quotes, normal, parse, units

SCHEMA = "conv_id long, turn long, role string, text string"
THREAD = [
    (1, 0, "user", "First thing.\nSecond thing here."), (1, 1, "assistant", "> first   THING.\nAnswer to that."), (1, 2, "user", "> > First thing.\n> Answer to that.\n\nFollow up."),
    (1, 3, "user", "> Second thing here.\nElse"), (1, 4, "user", "Unrelated\n> nobody said this"), (1, 5, "user", "> Follow up.\n> > Answer to that.\nend"),
    (2, 0, "user", "> First thing.\nother conversation"), (2, 1, "user", "same"), (2, 2, "user", "same"), (2, 3, "user", "> same\nre"), (2, 4, "user", None), (2, 5, "user", ""), (2, 6, "user", "> \n>\n"),
    (None, 0, "user", "First thing."), (None, 1, "user", "> First thing."), (3, None, "user", "> x"), (4, 0, "user", "dup"), (4, 0, "user", "dup too"), (4, 1, "user", "> dup too\nyes"), (4, 1, "user", "> dup too\nyes"),
]


def brute(data):
    first = defaultdict(dict)
    parsed = [(c, t, parse(x or "")) for c, t, _, x in data]
    for c, t, (_, runs) in parsed:
        for level, h1, h2, _ in units(runs):
            if level == 0 and c is not None and t is not None:
                first[c][h1, h2] = min(t, first[c].get((h1, h2), t))
    asked = defaultdict(dict)
    for c, t, (_, runs) in parsed:
        if c is not None and t is not None:
            asked[c, t].update({(level, h1, h2): w for level, h1, h2, w in units(runs) if level})
    parent = {}
    for (c, t), qs in asked.items():
        score = defaultdict(int)
        for (level, h1, h2), w in qs.items():
            o = first[c].get((h1, h2))
            if o is not None and o < t:
                score[-level, o] += w
        if score:
            parent[c, t] = max((lv, s, o) for (lv, o), s in score.items())[2]

    def root(c, t):
        depth = 0
        while (c, t) in parent:
            t, depth = parent[c, t], depth + 1
        return t, depth

    return sorted(((c, t, parent.get((c, t)), *root(c, t), b) for c, t, (b, _) in parsed), key=repr)


def test_equals_brute_force(spark):
    df = spark.createDataFrame(THREAD, SCHEMA).selectExpr("*", "1 AS units", "2 AS level", "3 AS root", "4 AS parent")
    got = [(r["conv_id"], r["turn"], r["parent_turn"], r["thread_root"], r["depth"], r["body"]) for r in link_quotes(df).collect()]
    assert sorted(got, key=repr) == brute(THREAD)
    by = {(c, t): p for c, t, p, *_ in got}
    assert [by[1, t] for t in range(6)] == [None, 0, 1, 0, None, 2] and by[2, 3] == 1 and by[2, 0] is None and by[4, 1] == 0


def test_long_chain_and_order(spark):
    chain = [(1, t, "user", (f"> message {t - 1} words\n" if t else "") + f"message {t} words") for t in range(40)]
    rows = link_quotes(spark.createDataFrame(chain, SCHEMA)).collect()
    assert {r["turn"]: (r["thread_root"], r["depth"]) for r in rows} == {t: (0, t) for t in range(40)}
    place = {r["turn"]: i for i, r in enumerate(rows)}
    assert all(place[t - 1] < place[t] for t in range(1, 40))
    assert link_quotes(spark.createDataFrame([], SCHEMA)).count() == 0


def quoted(data):
    """The quoting view by plain means."""
    said = {}
    for c, t, _, x in data:
        if c is not None and t is not None and x is not None:
            said[c, t] = min(x, said.get((c, t), x))
    out = []
    for c, t, role, x in data:
        one, two = said.get((c, t - 1)), said.get((c, t - 2)) if c is not None and t is not None else None
        rule, quote = (7 * c + t) % 4 if c is not None and t is not None else 0, None
        if one and rule == 1:
            quote = "\n".join("> " + line for line in one.translate({k: k - 32 for k in range(97, 123)}).split("\n"))
        elif one and rule == 2:
            quote = "\n".join("> " + line for line in one.replace(" ", "\n").split("\n"))
        elif one and rule == 3:
            quote = "\n".join(["> > " + line for line in two.split("\n")] if two else []) + ("\n" if two else "") + "\n".join("> " + line for line in one.split("\n"))
        out.append((c, t, role, x if quote is None else f"{quote}\n\n{x or ''}"))
    return out


def conversations():
    rng = random.Random(4)
    out = []
    for c in range(30):
        for t in range(rng.randrange(1, 9)):
            out.append((c, t, "user", "\n".join(" ".join(rng.choice(["Ok", "so", "WHAT", "é", "now", "then"]) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 4)))))
    return [*out, (40, 0, "user", None), (40, 1, "user", "a"), (40, 2, "user", ""), (40, 3, "user", "b"), (41, 5, "user", "late start"), (-3, 0, "user", "x y"), (-3, 1, "user", "z")]


def test_query_quotes_and_equals_brute_force_and_its_sql(spark, tmp_path):
    import duckdb

    data = conversations()
    assert sorted(map(repr, (tuple(r) for r in queries.quoting(spark.createDataFrame(data, SCHEMA)).collect()))) == sorted(map(repr, quoted(data)))
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    names = ["conv_id", "turn", "role", "parent_turn", "thread_root", "depth", "n_quotes", "body_sha256"]
    got = sorted((tuple(r[c] for c in names) for r in queries.op2(spark, str(tmp_path)).collect()), key=repr)
    want = [(c, t, p, root, depth, hashlib.sha256(b.encode()).hexdigest()) for c, t, p, root, depth, b in brute(quoted(data))]
    assert [(c, t, *x) for c, t, _, *x in ((r[:6] + r[7:]) for r in got)] == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(con.execute(sql.CHAT_QUOTES).fetchall(), key=repr)
    assert sum(r[3] is not None for r in got) > len(got) / 3 and max(r[5] for r in got) > 1 and max(r[6] for r in got) > 3


def test_long_text_and_a_conversation_with_most_messages(spark):
    """One text of a megabyte that is quoted whole, and one conversation that holds nearly all rows and one frequent line."""
    long = "\n".join(f"line {i} of a very long message" for i in range(30_000))
    data = [(1, 0, "user", long), (1, 1, "user", "\n".join("> " + x for x in long.split("\n")) + "\nyes")]
    data += [(7, t, "user", (f"> note {t - 1}\n" if t % 3 else "") + f"note {t}\nthanks") for t in range(3000)]
    got = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["thread_root"]) for r in link_quotes(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got[1, 1] == (0, 0) and len(got) == len(data)
    assert all(got[7, t] == ((t - 1, t - t % 3) if t % 3 else (None, t)) for t in range(3000))


def test_parse():
    own, runs = parse("a\n> b\n>> c\n> > d\ne\n  > f")
    assert own == "a\ne" and [(level, len(x)) for level, x in runs] == [(0, 1), (1, 1), (2, 2), (0, 1), (1, 1)]
    assert normal(" A \t b\x0bÉ") == "a b É".encode() and units([(1, ["", "  "])]) == []
