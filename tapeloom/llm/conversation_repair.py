"""Cheapest repair of conversations whose turns are damaged: which rows to keep, rerole or delete and
what to insert so that the roles read system? (user assistant)+ or nothing.

A conversation's signature is a letter for each row: the role's initial, in upper case if the text is
truncated, `x` if the row must go. Distinct signatures of all conversations are sorted by their reversal
and made into an automaton from the end, so that signatures with a common end share its nodes: a node
is registered by its letter and the node behind it, and two nodes whose tables agree but for a constant
cost are one (the register stays at some dozens of nodes, whatever the signatures). A node's table holds,
for each state of the grammar, the cost to go and the first edit of the least audit; it is made once.
The options of a state begin with different letters, so the least audit is told by its first edit, and
an audit is read off by one walk through the nodes of its signature.

Rows are first folded to light runs (conversation, turn, role, digest, copies). A range sort cuts long
conversations into pieces of whole partitions, at most one for each partition, whose letters and counts
are put together per conversation. The repaired texts then pass once, sorted by conversation and turn,
through tasks that hold one row and the conversation's edits. A SHA-256 reads its input in order, so one
conversation's kept texts pass through one task however many they are; they are streamed, not collected.

Rows of one turn go by role, then by the SHA-256 of their text; null turns come first. Null roles and
texts read as one space; null ids are one conversation. A role other than s..., u..., a... (also the
empty one) fits nowhere and can be reroled or deleted. Rows that repeat whole are duplicates of the
first. A row with copies = 0 is not there, but its conversation is in the result: without rows all counts
are zero and the audit is empty. An empty table gives an empty result. A signature and an audit have to
fit in a row. A gap too large for a long is given as the largest long.
"""
from __future__ import annotations

from array import array
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import stage
from .common import arrow_map, pick
from .merkle import crc_sql

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
SPACE = " \t\n\x0b\x0c\r"
#: Grammar state -> (role that may come next, state after it). 0: nothing yet, 1: system, 2: user, 3: assistant.
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
DONE = (0, 3)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(turns: DataFrame, by: int = 20) -> DataFrame:
    """turns (conv_id, turn, role, text) with damage told by crc32(`conv_id:turn`) % by, and copies."""
    t = pick(turns, "conv_id", "turn", "role", "text")
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    t = t.withColumn("_code", F.crc32(key.cast("binary")) % by)
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    return t.select("conv_id", "turn", F.when(F.col("_code") == 4, "user").otherwise(role).alias("role"),
                    F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                    F.when(F.col("_code") == 0, 0).when(F.col("_code") == 3, 2).otherwise(1).alias("copies"))


class Automaton:
    """Tables of suffixes: node -> (cost to go, first edit) by state, costs less their minimum."""

    def __init__(self):
        self.tables: list[tuple[tuple[int, ...], tuple[str, ...]]] = []
        self.number: dict[tuple, int] = {}
        self.made: dict[tuple[str, int], tuple[int, int]] = {}
        far = float("inf")
        self.end, _ = self._table([{"": 0} if q in DONE else {} for q in NEXT], far)

    def _table(self, options: list[dict[str, float]], far=float("inf")) -> tuple[int, int]:
        cost = [min(o.values(), default=far) for o in options]
        for _ in NEXT:
            cost = [min(c, INSERT + cost[NEXT[q][1]]) for q, c in enumerate(cost)]
        first = tuple(min([e for e, c in o.items() if c == cost[q]] + ["I"] * (INSERT + cost[NEXT[q][1]] == cost[q]))
                      for q, o in enumerate(options))
        low = min(cost)
        key = (tuple(int(c - low) for c in cost), first)
        if key not in self.number:
            self.number[key] = len(self.tables)
            self.tables.append(key)
        return self.number[key], int(low)

    def before(self, letter: str, behind: int) -> tuple[int, int]:
        """(node, cost taken out of its table) of a row in front of the suffix `behind`."""
        if (letter, behind) not in self.made:
            cost, options = self.tables[behind][0], []
            for q, (role, then) in NEXT.items():
                o = {"D": DELETE + cost[q]}
                if letter != "x":
                    more, kind = (TRUNCATED if letter.isupper() else 0), letter.lower()
                    o["R"] = REROLE + more + cost[then]
                    if kind == role[0]:
                        o["K"] = more + cost[then]
                    elif kind == "s" and q == 0:
                        o["K"] = more + cost[1]
                options.append(o)
            self.made[letter, behind] = self._table(options)
        return self.made[letter, behind]

    def audit(self, letters: str, nodes) -> str:
        """The least audit; nodes[k] is the node of the last k letters."""
        out, i, q, n = [], 0, 0, len(letters)
        while edit := self.tables[nodes[n - i]][1][q]:
            out.append(edit)
            if edit == "I":
                q = NEXT[q][1]
                continue
            if edit == "K" and letters[i] in "sS":
                q = 1
            elif edit != "D":
                q = NEXT[q][1]
            i += 1
        return "".join(out)


def solved(signatures) -> list:
    """Yields (signature, cost, audit, audit without the rows that must go) for signatures sorted by
    their reversal."""
    a = Automaton()
    nodes, costs, last = array("i", [a.end]), array("q", [0]), ""
    for s in signatures:
        back, same = s[::-1], 0
        for x, y in zip(back, last):
            if x != y:
                break
            same += 1
        del nodes[same + 1:], costs[same + 1:]
        for letter in back[same:]:
            node, cost = a.before(letter, nodes[-1])
            nodes.append(node)
            costs.append(costs[-1] + cost)
        last = back
        audit = a.audit(s, nodes)
        kept, i = [], 0
        for edit in audit:
            if edit == "I":
                kept.append(edit)
            else:
                if s[i] != "x":
                    kept.append(edit)
                i += 1
        yield s, costs[-1] + a.tables[nodes[-1]][0][0], audit, "".join(kept)


def _legal(pair: Column) -> Column:
    return pair.isin("su", "ua", "au")


def _pieces(runs: DataFrame) -> DataFrame:
    """A row for each conversation and range partition: letters, counts and both ends. Rows are
    (conv_id, turn, role, digest, m, letter, initial, late)."""
    key = runs.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "known", "turn", "role", "digest", "letters", "first", "last", "blank", "duplicate", "truncated", "illegal",
             "turns", "low", "high"]
    kinds = [key, "boolean", "bigint", "string", "binary", "string", "string", "string", *["bigint"] * 7]

    def run(batches):
        held = None
        for b in batches:
            done = []
            for conv, turn, role, digest, m, letter, initial, late in zip(*[c.to_pylist() for c in b.columns]):
                if held is None or held[0] != conv:
                    if held is not None:
                        done.append(held)
                    held = [conv, turn is not None, turn, role, digest, [], "", "", 0, 0, 0, 0, 0, None, None]
                if not m:
                    continue
                if held[7]:
                    held[11] += held[7] + initial not in ("su", "ua", "au")
                else:
                    held[6] = initial
                held[7] = initial
                held[11] += m - 1
                if letter == "x":
                    held[8] += m
                else:
                    held[9] += m if late else m - 1
                    held[10] += not late and letter.isupper()
                held[5].append("x" * m if late else letter + "x" * (m - 1))
                if turn is not None and turn != held[14]:
                    held[12] += 1
                    held[14] = turn
                    if held[13] is None:
                        held[13] = turn
            if done:
                yield table(done, b.schema.field(0).type)
        if held is not None:
            yield table([held], b.schema.field(0).type)

    def table(rows, kind):
        columns = [list(c) for c in zip(*rows)]
        columns[5] = ["".join(x) for x in columns[5]]
        types = [kind, pa.bool_(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 7]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    order = ["conv_id", "turn", "role", "digest"]
    placed = runs.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "m", "letter", "initial", "late")
    return arrow_map(placed, run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def _rows(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, digest, blank) of turns, nulls read as one space."""
    t = pick(turns, "conv_id", "turn", "role", "text", *(["copies"] if "copies" in turns.columns else []))
    if "copies" not in turns.columns:
        t = t.withColumn("copies", F.lit(1))
    t = t.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                 F.coalesce("text", F.lit(" ")).alias("text"), F.col("copies").cast("bigint").alias("copies"))
    return (t.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("_bare", F.rtrim(F.col("text"), F.lit(SPACE)))
            .withColumn("blank", F.col("_bare") == "").withColumn("end", F.right(F.col("_bare"), F.lit(1))).drop("_bare"))


def _place(turn: Column) -> Column:
    return F.struct(turn.isNotNull().alias("known"), turn.alias("turn"))


def repairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, rows): what is wrong with each conversation of turns (conv_id, turn, role, text and,
    if there, copies) and its cheapest repair, and the rows a repair may keep."""
    rows = _rows(turns)
    initial = F.left("role", F.lit(1))
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("blank"), "x").when(F.col("end").isin(".", "!", "?"), initial).otherwise(F.upper(initial))
    runs = stage(rows.groupBy("conv_id", "turn", "role", "digest", letter.alias("letter"), initial.alias("initial"))
                 .agg(F.sum("copies").alias("m")))
    again = (runs.where("m > 0").groupBy("conv_id", "role", "digest").agg(F.min(_place(F.col("turn"))).alias("start"), F.count("*").alias("n"))
             .where("n > 1").select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "start"))
    again = stage(again)

    def late(t: DataFrame) -> DataFrame:
        same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
        return (t.join(again, same, "left").withColumn("late", F.coalesce(_place(F.col("turn")) > F.col("start"), F.lit(False)))
                .drop("_conv", "_role", "_digest", "start"))

    p = _pieces(late(runs))
    parts = F.array_sort(F.collect_list(F.struct("known", "turn", "role", "digest", "letters", "first", "last", "low", "high")))
    p = p.groupBy("conv_id").agg(parts.alias("p"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")],
                                 F.min("low").alias("low"), F.max("high").alias("high"))
    full = F.filter("p", lambda x: x["letters"] != "")
    ahead, behind = F.slice("f", 1, F.greatest(F.size("f") - 1, F.lit(0))), F.slice("f", 2, F.greatest(F.size("f"), F.lit(1)))

    def met(test) -> Column:
        return F.size(F.filter(F.zip_with(ahead, behind, lambda x, y: F.coalesce(test(x, y), F.lit(False))), lambda x: x))

    wide = "decimal(38,0)"
    span = F.col("high").cast(wide) - F.col("low").cast(wide) + 1 - (F.col("turns") - met(lambda x, y: x["high"] == y["low"])).cast(wide)
    each = stage(p.withColumn("f", full).select(
        "conv_id", F.array_join(F.transform("f", lambda x: x["letters"]), "").alias("letters"),
        F.least(F.coalesce(span, F.lit(0).cast(wide)), F.lit(2 ** 63 - 1).cast(wide)).cast("bigint").alias("gaps"),
        "blank", "duplicate", "truncated",
        (F.col("illegal") + met(lambda x, y: ~_legal(F.concat(x["last"], y["first"])))).alias("illegal")))

    def solve(batches):
        def signatures():
            for b in batches:
                yield from b.column(0).to_pylist()

        out, size = [], 0
        for r in solved(signatures()):
            out.append(r)
            size += 3 * len(r[0])
            if size > 1 << 20:
                yield found(out)
                out, size = [], 0
        if out:
            yield found(out)

    def found(rows):
        types = (pa.string(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["letters", "cost", "audit", "edits"])

    back = each.select("letters").distinct().withColumn("_back", F.reverse("letters"))
    table = arrow_map(back.repartitionByRange("_back").sortWithinPartitions("_back").select("letters"), solve,
                      "letters string, cost bigint, audit string, edits string")
    conversations = each.join(table, "letters").drop("letters")
    kept = late(rows.where("copies > 0 and not blank")).where("not late")
    return conversations, kept.select("conv_id", "turn", "role", "digest", "text")


def _sorted(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Both as one table, a conversation's line in front of its rows."""
    both = (conversations.withColumn("row", F.lit(0))
            .unionByName(rows.withColumn("row", F.lit(1)), allowMissingColumns=True)
            .repartition("conv_id").sortWithinPartitions("conv_id", "row", "turn", "role", "digest"))
    return both.select("conv_id", "row", "turn", "role", "digest", "text", "edits", *COUNTS, "audit")


class Walk:
    """The repaired rows of one conversation, given its edits and then its rows in order."""

    def __init__(self, edits: str):
        self.edits, self.at, self.state, self.last = edits, 0, 0, None

    def row(self, key, role, text):
        """(edit, role, text) of what stands up to and including this row."""
        if key == self.last:
            return
        self.last = key
        yield from self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "D":
            return
        if edit == "K" and role[:1] == "s":
            self.state = 1
        else:
            want, self.state = NEXT[self.state]
            role = role if edit == "K" else want
        yield edit, role, text

    def inserted(self):
        while self.edits[self.at:self.at + 1] == "I":
            self.at += 1
            role, self.state = NEXT[self.state]
            yield "I", role, ""


def _walked(batches):
    """(line of the conversation, generator of repaired rows or None at its end) over sorted rows."""
    line = walk = None
    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns]):
            if r[1] == 0:
                if walk:
                    yield line, walk.inserted(), True
                line, walk = r, Walk(r[6])
            else:
                yield line, walk.row(r[2:5], r[3], r[5]), False
    if walk:
        yield line, walk.inserted(), True


def _batch(rows, types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], names=list(types))


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text) of the repaired conversations."""
    kind = turns.schema[turns.columns.index("conv_id")].dataType

    def run(batches):
        out, place = [], 0
        for line, rows, end in _walked(batches):
            for edit, role, text in rows:
                out.append((line[0], place, edit, role, text))
                place += 1
            if end:
                place = 0
            if len(out) >= 1024:
                yield _batch(out, types)
                out = []
        if out:
            yield _batch(out, types)

    types = {"conv_id": to_arrow_type(kind), "place": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}
    return arrow_map(_sorted(*repairs(turns)), run, f"conv_id {kind.simpleString()}, place bigint, edit string, role string, text string")


def report(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every
    conversation; the digest is of the repaired rows `role:text`, joined by newlines."""
    kind = turns.schema[turns.columns.index("conv_id")].dataType
    types = {"conv_id": to_arrow_type(kind), **{c: pa.int64() for c in COUNTS}, "audit": pa.string(), "repaired_sha256": pa.string()}

    def run(batches):
        out, digest, some, size = [], sha256(), False, 0
        for line, rows, end in _walked(batches):
            for _, role, text in rows:
                digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True
            if end:
                out.append((line[0], *line[7:], digest.hexdigest()))
                digest, some, size = sha256(), False, size + len(line[13])
            if len(out) >= 4096 or size > 1 << 22:
                yield _batch(out, types)
                out, size = [], 0
        if out:
            yield _batch(out, types)

    schema = f"conv_id {kind.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string"
    return arrow_map(_sorted(*repairs(turns)), run, schema)


SQL = f"""
WITH RECURSIVE damaged AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS code
  FROM conversations),
names AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
kept AS (
  SELECT n.conv, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM damaged d JOIN names n ON n.conv_id IS NOT DISTINCT FROM d.conv_id),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM kept),
rows AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS ahead,
    CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM seen),
counts AS (
  SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank,
    count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
    count_if(ahead IS NOT NULL AND ahead || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv),
inserts AS (SELECT * FROM (VALUES (0,0,0), (0,1,2), (0,2,3), (1,0,1), (1,1,2), (1,2,3), (2,0,2), (2,1,3), (3,0,3), (3,1,2)) t(q, times, r)),
moves AS (
  SELECT * FROM (VALUES (0,'K','s',1), (0,'K','u',2), (1,'K','u',2), (2,'K','a',3), (3,'K','u',2),
    (0,'R','*',2), (1,'R','*',2), (2,'R','*',3), (3,'R','*',2), (0,'D','*',0), (1,'D','*',1), (2,'D','*',2), (3,'D','*',3)) t(r, edit, kind, s)),
best AS (
  SELECT conv, n + 1 AS i, q, {INSERT} * times AS cost, repeat('I', times) AS audit FROM counts, inserts WHERE r IN (0, 3)
  UNION ALL
  SELECT b.conv, b.i - 1, x.q, min({INSERT} * x.times + b.cost + CASE m.edit WHEN 'D' THEN {DELETE} WHEN 'R' THEN {REROLE} ELSE 0 END
      + CASE WHEN m.edit <> 'D' AND w.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END),
    arg_min(repeat('I', x.times) || m.edit || b.audit, ({INSERT} * x.times + b.cost + CASE m.edit WHEN 'D' THEN {DELETE} WHEN 'R' THEN {REROLE} ELSE 0 END
      + CASE WHEN m.edit <> 'D' AND w.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END, repeat('I', x.times) || m.edit || b.audit))
  FROM best b JOIN rows w ON w.conv = b.conv AND w.i = b.i - 1 JOIN moves m ON m.s = b.q AND m.kind IN ('*', w.initial)
    AND (m.edit = 'D' OR w.fault NOT IN ('blank', 'duplicate')) JOIN inserts x ON x.r = m.r
  GROUP BY b.conv, b.i, x.q),
chosen AS (SELECT conv, cost, audit FROM best WHERE i = 1 AND q = 0),
walk AS (
  SELECT conv, audit, 1 AS pos, 1 AS i, 0 AS q, CAST([] AS VARCHAR[]) AS made FROM chosen
  UNION ALL
  SELECT k.conv, k.audit, k.pos + 1, k.i + CASE WHEN k.audit[k.pos] = 'I' THEN 0 ELSE 1 END,
    CASE WHEN k.audit[k.pos] = 'D' THEN k.q WHEN k.audit[k.pos] = 'K' AND w.initial = 's' THEN 1 WHEN k.q = 2 THEN 3 ELSE 2 END,
    CASE k.audit[k.pos] WHEN 'D' THEN k.made WHEN 'K' THEN list_append(k.made, w.role || ':' || w.text)
      ELSE list_append(k.made, CASE WHEN k.q = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE k.audit[k.pos] WHEN 'R' THEN w.text ELSE '' END) END
  FROM walk k LEFT JOIN rows w ON w.conv = k.conv AND w.i = k.i WHERE k.pos <= length(k.audit)),
done AS (SELECT conv, sha256(array_to_string(made, chr(10))) AS digest FROM walk WHERE pos = length(audit) + 1)
SELECT n.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, CAST(coalesce(h.cost, 0) AS BIGINT) AS cost, coalesce(h.audit, '') AS audit, coalesce(d.digest, sha256('')) AS repaired_sha256
FROM names n LEFT JOIN counts c USING (conv) LEFT JOIN chosen h USING (conv) LEFT JOIN done d USING (conv)
"""
