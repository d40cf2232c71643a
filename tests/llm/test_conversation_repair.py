"""Repairs against a search over all edits, row by row."""
import random
import zlib
from collections import defaultdict
from hashlib import sha256
from heapq import heappop, heappush

import duckdb
import pytest

from tapeloom.llm import conversation_repair as repair

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, digest string, row int, letters string, p string, copies_ int"


def cheapest(faults, initials):
    """(cost, audit): the least of all edit strings, by a search that grows them cost by cost."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, made = heappop(heap)
        last = made[-1:]
        if i == len(faults) and last in ("", "a"):
            return cost, audit  # what is left costs more or reads greater, and so does all that grows from it
        if (cost, audit, i, made) in seen or len(made) > len(faults) + 3:
            continue
        seen.add((cost, audit, i, made))
        nxt = "a" if last == "u" else "u"
        heappush(heap, (cost + 5, audit + "I", i, made + nxt))
        if i < len(faults):
            heappush(heap, (cost + 2, audit + "D", i + 1, made))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                heappush(heap, (cost + 1 + more, audit + "R", i + 1, made + nxt))
                if initials[i] == nxt or initials[i] == "s" and not made:
                    heappush(heap, (cost + more, audit + "K", i + 1, made + initials[i]))


def plain(rows):
    """Result rows for rows (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        there = convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        there += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    out = []
    for conv, there in convs.items():
        there.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in there:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in there]
        turns = {r[0] for r in there if r[0] is not None}
        cost, audit = cheapest(faults, initials)
        made, i = [], 0
        for e in audit:
            need = "assistant" if made and made[-1][0][:1] == "u" else "user"
            if e == "I":
                made.append((need, ""))
                continue
            if e != "D":
                made.append((there[i][1] if e == "K" else need, there[i][2]))
            i += 1
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()))
    return sorted(out, key=str)


def awkward():
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "ux"]), rng.choice(["Yes.", "No", "Why?", "A b!\n ", f"{c} {t}."]))
            for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(100, None, None, None), (100, None, "user", "hm."), (100, None, "assistant", "hm."), (None, 3, "user", "x."), (None, 3, "user", "x."),
             (None, None, "assistant", "y."), (101, 5, "", "a."), (101, 9, "user", " \t\x0b"), (101, 7, "assistant", " "), (102, 1, "system", "s."),
             (103, 2, "user", "long. " * 20_000), (103, 4, "assistant", "ü?"), (104, 2 ** 62, "user", "q?"), (104, -2 ** 62, "user", "q?")]
    rows += [(105, t, "user" if t % 2 else "assistant", f"{t % 3}.") for t in range(9)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "l", "p", 0) for r in rows], SCHEMA)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_against_search(spark):
    rows = awkward()
    df = frame(spark, rows)
    want = plain(rows)
    assert got(repair.report(repair.damage(df))) == want
    assert repair.report(repair.damage(df.where("false"))).collect() == []
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r for r in rows if r[0] != 104])
    assert sorted(con.execute(repair.SQL).fetchall(), key=str) == [r for r in want if r[0] != 104]


def test_long_conversation_in_pieces(spark):
    """A conversation over many partitions has the counts, cost and audit of one that is in one."""
    rows = [(1, t, ("user", "assistant")[t % 2] if t % 7 else "system", f"t{t % 40}" + "." * (t % 5 > 0)) for t in range(3000)]
    rows += [(2, t, "user", "a.") for t in range(30)]
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        many = got(repair.report(frame(spark, rows).repartition(20)))
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert many == got(repair.report(frame(spark, rows)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    one = {r[0]: r for r in many}
    assert one[2][1:4] == (0, 0, 29) and one[2][5] == 29 and one[1][3] > 2000


def test_repaired_turns_are_legal(spark):
    df = frame(spark, awkward())
    made = defaultdict(list)
    for r in repair.repaired_turns(repair.damage(df)).collect():
        made[r["conv_id"]].append((r["place"], r["edit"], r["role"], r["text"]))
    digests = {r["conv_id"]: r["repaired_sha256"] for r in repair.report(repair.damage(df)).collect()}
    for conv, digest in digests.items():
        turns = sorted(made[conv])
        initials = "".join(r[2][0] for r in turns)
        rest = initials.removeprefix("s")
        assert rest == "ua" * (len(rest) // 2) and initials != "s"
        assert digest == sha256("\n".join(f"{r}:{t}" for _, _, r, t in turns).encode()).hexdigest()


@pytest.mark.parametrize("shared", ("", "x", "uaua"))
def test_nodes_are_shared(shared):
    """Signatures with a common end add no nodes for it, and the register stays small."""
    a = repair.Automaton()
    node = a.end
    for letter in reversed("UaxuaSo" * 500 + shared):
        node, _ = a.before(letter, node)
    assert len(a.tables) < 60
    assert [r[1:3] for r in repair.solved(["", "ua", "sua", "uua"])] == [(0, ""), (0, "KK"), (0, "KKK"), (2, "DKK")]
