"""Repair of the structure of conversations by a fold in Spark SQL.

A conversation is well formed if the initials of its roles read `(s?(ua)+)?`. Rows of a
conversation are read by turn (nulls first; rows of one turn by role, then text). Each has
a fault or none: blank (no character but ASCII white space), duplicate (role and text seen
earlier), truncated (the last character that is no white space is none of `.!?`); the
first that holds counts. The cheapest edits that give a well-formed conversation:

    Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty user or assistant turn 2

A blank or duplicate row must go; a truncated row that stays costs 1 more. Of equally
cheap edits those whose initials are least as a string count.

Where a prefix of the edits leaves the conversation - nothing yet, after a system, a user
or an assistant turn - decides what may follow, so a fold over the rows carries four
(cost, audit) structs and takes the least at each step. Faults come from a window over
equal rows. Two prefixes of the same rows that end alike and cost the same never begin one
another (one would have more insertions), so the lesser one stays the lesser whatever
follows, and the fold is exact.

Scale: a conversation is dealt into stripes of 2^STRIPE_BITS turns, which are sorted and folded
each for itself, from each of the four states: a 4 by 4 table of (cost, audit). Joining
the tables of a conversation in order is another such fold. So neither sorting nor the
audits' growth is quadratic in a conversation, however long, and a hot conversation's rows
are spread. Only its repaired rows, tables and audit, which has a letter for each row,
meet in one row, as the result asks for them; a conversation must fit in one Spark row
(2 GB).

Defined cases: a null role or text is one space. A null turn stands before all others, a
null conversation id is an id. Repeated rows of one turn are duplicates of the first. Roles
that begin otherwise than s, u or a can only be changed or deleted; an empty role has no
initial. Empty texts are blank. An empty table gives an empty result. Turns are integers;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Turns that are folded in one row, as a power of two.
STRIPE_BITS = 8
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Where a prefix has led: nothing yet, after a system, a user, an assistant turn.
STATES = ("0", "s", "u", "a")
NEVER = 1 << 40


def _cell(cost: Column | int, *audit: Column | str) -> Column:
    cost = F.lit(cost) if isinstance(cost, int) else cost
    return F.struct(cost.cast("long").alias("cost"), F.concat(*[F.lit(a) if isinstance(a, str) else a for a in audit]).alias("audit"))


def _plus(cell: Column, cost: Column | int, letter: Column | str) -> Column:
    return _cell(cell["cost"] + cost, cell["audit"], letter)


def _cells(*cells: Column) -> Column:
    return F.struct(*[c.alias(s) for s, c in zip(STATES, cells, strict=True)])


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _inserted(acc: Column) -> Column:
    """After any insertions: a user's turn after nothing, a system's or an assistant's turn, an assistant's after a user's."""
    zero, s, u, a = (acc[x] for x in STATES)
    ins = lambda c: _plus(c, INSERT, "I")
    return _let(_cells(zero, s, F.least(u, ins(zero), ins(s), ins(a)), a), lambda x: _cells(x["0"], x["s"], x["u"], F.least(x["a"], ins(x["u"]))))


def _row(acc: Column, r: Column) -> Column:
    """After one more row r (as_s, as_u, as_a: what it costs in that role; u, a: the edit's letter there)."""
    gone = lambda c: _plus(c, DELETE, "D")
    user = lambda c: _plus(c, r["as_u"], r["u"])
    return _cells(
        gone(acc["0"]), F.least(gone(acc["s"]), _plus(acc["0"], r["as_s"], "K")),
        F.least(gone(acc["u"]), user(acc["0"]), user(acc["s"]), user(acc["a"])), F.least(gone(acc["a"]), _plus(acc["u"], r["as_a"], r["a"])),
    )


def fold_rows(rows: Column) -> Column:
    """Table [from][to] of the cheapest edits of a stripe's rows, states in the order of STATES."""
    start = lambda e: _cells(*[_cell(0 if s == e else NEVER, "") for s in STATES])
    step = lambda acc, r: _let(_inserted(acc), lambda x: _row(x, r))
    return F.array(*[F.aggregate(rows, start(e), step, lambda acc: F.array(*[acc[s] for s in STATES])) for e in STATES])


def fold_stripes(stripes: Column) -> Column:
    """(cost, audit, path) of the cheapest edits of a whole conversation; path has the state before each stripe and the last one."""
    cell = lambda cost, audit, path: F.struct(cost.alias("cost"), audit.alias("audit"), path.alias("path"))
    start = _cells(*[cell(F.lit(0 if s == "0" else NEVER).cast("long"), F.lit(""), F.lit("")) for s in STATES])

    def joined(acc: Column, stripe: Column) -> Column:
        def to(x: int) -> Column:
            part = lambda e: stripe["table"][e][x]
            return F.least(*[cell(acc[s]["cost"] + part(e)["cost"], F.concat(acc[s]["audit"], part(e)["audit"]), F.concat(acc[s]["path"], F.lit(s))) for e, s in enumerate(STATES)])

        return _cells(*[to(x) for x in range(4)])

    def ended(acc: Column) -> Column:
        last = lambda s, n: cell(acc[s]["cost"] + n * INSERT, F.concat(acc[s]["audit"], F.lit("I" * n)), F.concat(acc[s]["path"], F.lit(s)))
        return F.least(last("0", 0), last("a", 0), last("u", 1), last("s", 2))

    return F.aggregate(stripes, start, joined, ended)


def _repaired(stripe: Column, i: Column, path: Column) -> Column:
    """Repaired (role, text) of a stripe, given the states around it."""
    state = lambda j: F.substring(path, j + 1, 1)
    number = lambda c: F.when(c == "0", 0).when(c == "s", 1).when(c == "u", 2).otherwise(3)
    audit = F.get(F.get(stripe["table"], number(state(i))), number(state(i + 1)))["audit"]
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")

    def edited(r: Column, edit: Column) -> Column:
        added = F.array_repeat(turn(none, F.lit("")), F.length(edit) - 1)
        own = F.when(edit.endswith("K"), F.array(turn(r["role"], r["text"]))).when(edit.endswith("R"), F.array(turn(none, r["text"])))
        return F.concat(added, F.coalesce(own, F.array().cast("array<struct<role:string,text:string>>")))

    out = F.flatten(F.zip_with(stripe["rows"], F.regexp_extract_all(audit, F.lit("(I*[KRD])"), 1), edited))
    # users and assistants take turns; one place later after a user's turn or where the system speaks first
    late = lambda o: F.when((state(i) == "u") | ((state(i) == "0") & F.coalesce(F.get(o, F.lit(0))["role"].startswith("s"), F.lit(False))), 1).otherwise(0)
    return _let(out, lambda o: F.transform(o, lambda x, j: turn(F.coalesce(x["role"], F.when((j + late(o)) % 2 == 0, "user").otherwise("assistant")), x["text"])))


def with_faults(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, there: Column) -> DataFrame:
    """(conv, turn, role, text, there, seen, fault)."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"), there.alias("there"))
    rows = rows.withColumn("seen", F.row_number().over(W.partitionBy("conv", "there", "role", "text").orderBy("turn")))
    blank, cut = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return rows.withColumn("fault", F.when(blank, "blank").when(F.col("seen") > 1, "duplicate").when(cut, "truncated").otherwise(""))


def repair_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", there: Column | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of every conversation.
    Rows where `there` does not hold only tell that the conversation exists."""
    rows = with_faults(turns, conv_col, turn_col, role_col, text_col, F.lit(True) if there is None else there)
    first, must, extra = F.substring("role", 1, 1), F.col("fault").isin("blank", "duplicate"), F.when(F.col("fault") == "truncated", TRUNCATED).otherwise(0)
    cost = lambda s, other: F.when(must, NEVER).when(first == s, extra).otherwise(extra + other).cast("long").alias(f"as_{s}")
    letter = lambda s: F.when(first == s, "K").otherwise("R").alias(s)
    rows = rows.select("conv", "turn", F.shiftright("turn", STRIPE_BITS).alias("stripe"), "there", F.struct("turn", "role", "text", "seen", "fault", first.alias("first"), cost("s", NEVER), cost("u", REROLE), cost("a", REROLE), letter("u"), letter("a")).alias("row"))
    here = F.when(F.col("there"), F.col("turn"))
    stripes = rows.groupBy("conv", "stripe").agg(F.array_sort(F.collect_list(F.when(F.col("there"), F.col("row")))).alias("rows"), F.min(here).alias("low"), F.max(here).alias("high"))
    own = F.size(F.array_compact(F.array_distinct(F.transform("rows", lambda r: r["turn"]))))  # a turn is in one stripe only
    stripes = stripes.withColumns({"table": fold_rows(F.col("rows")), "turns": own})
    convs = stripes.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("stripe", "rows", "table"))).alias("stripes"), (F.max("high") - F.min("low") + 1 - F.sum("turns")).alias("gaps"))
    convs = convs.withColumn("best", fold_stripes(F.col("stripes")))
    initials = F.flatten(F.transform("stripes", lambda s: F.transform(s["rows"], lambda r: r["first"])))
    faults = F.flatten(F.transform("stripes", lambda s: F.transform(s["rows"], lambda r: r["fault"])))
    convs = convs.withColumns({"initials": initials, "faults": faults})
    legal = lambda a, b: F.concat(a, b).isin("su", "ua", "au")
    pairs = F.zip_with("initials", F.slice("initials", 2, F.greatest(F.size("initials") - 1, F.lit(0))), lambda a, b: legal(a, b))
    count = lambda name: F.size(F.filter("faults", lambda f: f == name)).cast("long").alias(name)
    path = F.col("best.path")
    tail = [F.struct(F.lit(r).alias("role"), F.lit("").alias("text")) for r in ("user", "assistant")]
    ending = F.when(path.endswith("u"), F.array(tail[1])).when(path.endswith("s"), F.array(*tail)).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    repaired = F.concat(F.flatten(F.transform("stripes", lambda s, i: _repaired(s, i, path))), ending)
    return convs.select(
        "conv", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), *map(count, ("blank", "duplicate", "truncated")), F.size(F.filter(pairs, lambda x: ~x)).cast("long").alias("illegal"),
        F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), repaired.alias("repaired"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations with faults put in by the checksum of `conv_id:turn` modulo 20: 0 drops the row
    (there is false), 1 empties its text, 2 removes `.!?`, 3 repeats it, 4 makes it a user's. Nulls are one space."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_time")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"), times).drop("_time")
