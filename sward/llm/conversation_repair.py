"""Structure repair of conversations: the cheapest edits that make the roles a legal exchange, with an audit of them.

Turns become symbols of role and fault. A conversation, or a stretch of at most ``STRETCH`` turns of a long one, is a word
of such symbols; equal words are solved once. Words are read from the end: sorted by their reversed text, words with a
common ending follow each other, so the automaton of endings is built along a stack, and the cost-to-go and the best audit
of each of its nodes are found once for each grammar state. Stretches are joined by their costs from state to state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sward.session import materialize

#: Grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ACCEPTING = (START, ASSISTANT)
#: State after a turn whose role begins with a letter; no entry where it is not allowed.
MOVES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The role that a changed or inserted turn takes, and the state after it.
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT_STATE = (USER, USER, ASSISTANT, USER)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Turns in a word. Longer conversations are several words.
STRETCH = 256
NEVER = 1 << 40
BLANKS = " \t\n\x0b\x0c\r"


def symbols_of(initial: str, must_go: bool, truncated: bool) -> str:
    """The symbol of a turn: ``d`` if it has to be deleted, else its role's letter (``o``: none of the grammar's), as a
    capital if it is truncated."""
    if must_go:
        return "d"
    letter = initial if initial in ("s", "u", "a") else "o"
    return letter.upper() if truncated else letter


Node = list[tuple[int, tuple | None]]  # for each state: cost-to-go, and the edits as a linked list (edit, rest)


def _chosen(options: list[list[tuple[int, str, tuple | None]]]) -> Node:
    """The best of the options (cost, edit, edits after it) of each state, or after turns that are inserted before. Of equal
    costs the least first letter wins: edits begin with different letters, so no further letter has to be compared."""
    cost = [min((o[0] for o in own), default=NEVER) for own in options]
    for _ in STATES:
        cost = [min(cost[q], cost[NEXT_STATE[q]] + INSERT) for q in STATES]
    out: Node = [(NEVER, None)] * 4
    for q in sorted(STATES, key=cost.__getitem__):  # an inserted turn leads to a state of less cost, which is done by then
        if cost[q] < NEVER:
            own = [(e, rest) for c, e, rest in options[q] if c == cost[q]]
            if cost[NEXT_STATE[q]] + INSERT == cost[q]:
                own.append(("I", out[NEXT_STATE[q]][1]))
            best = min(own, key=lambda o: o[0])
            out[q] = (cost[q], best if best[0] else None)
    return out


def ended(states: tuple[int, ...]) -> Node:
    """The node of the empty word, where it is over in one of ``states``."""
    return _chosen([[(0, "", None)] if q in states else [] for q in STATES])


def before(symbol: str, after: Node) -> Node:
    """The node of a word from its first symbol and the node of the rest."""
    fault, role = (TRUNCATED if symbol.isupper() else 0), symbol.lower()
    options: list[list[tuple[int, str, tuple | None]]] = []
    for q in STATES:
        own = [(after[q][0] + DELETE, "D", after[q][1])]
        if symbol != "d":
            to = MOVES[q].get(role)
            if to is not None:
                own.append((after[to][0] + fault, "K", after[to][1]))
            to = NEXT_STATE[q]
            own.append((after[to][0] + fault + REROLE, "R", after[to][1]))
        options.append([o for o in own if o[0] < NEVER])
    return _chosen(options)


def spelled(edits: tuple | None) -> str:
    out = []
    while edits:
        out.append(edits[0])
        edits = edits[1]
    return "".join(out)


class Endings:
    """Words are given by reversed text in ascending order; nodes of the ending shared with the word before are kept."""

    def __init__(self, ends: list[tuple[int, ...]]):
        self.word, self.nodes = "", [[ended(e) for e in ends]]
        self.built = 0

    def solve(self, reversed_word: str) -> list[Node]:
        same = 0
        while same < min(len(self.word), len(reversed_word)) and self.word[same] == reversed_word[same]:
            same += 1
        del self.nodes[same + 1 :]
        for symbol in reversed_word[same:]:
            self.nodes.append([before(symbol, n) for n in self.nodes[-1]])
            self.built += 1
        self.word = reversed_word
        return self.nodes[-1]


_WORD = pa.schema([("whole", pa.bool_()), ("word", pa.string()), ("cost", pa.list_(pa.int64())), ("edits", pa.list_(pa.string()))])


def _solve(batches):
    """Costs and edits of words: of a whole conversation one of each; of a stretch, those from each state to each."""
    whole, part = Endings([ACCEPTING]), Endings([(q,) for q in STATES])
    for batch in batches:
        out = []
        for is_whole, word in zip(batch.column("whole").to_pylist(), batch.column("reversed").to_pylist(), strict=True):
            if is_whole:
                found = [whole.solve(word)[0][START]]
            else:
                ends = part.solve(word)
                found = [ends[b][a] for a in STATES for b in STATES]
            out.append({"whole": is_whole, "word": word[::-1], "cost": [c for c, _ in found], "edits": [spelled(e) for _, e in found]})
        yield pa.RecordBatch.from_pylist(out, _WORD)


def solved(words: DataFrame) -> DataFrame:
    """(whole, word) to (whole, word, cost, edits). Distinct words are dealt out by their endings, so that words that share
    one are solved next to each other; a border between tasks costs one word's nodes again."""
    kinds = words.select("whole", "word").distinct().select("whole", F.reverse("word").alias("reversed"))
    near = kinds.repartitionByRange("whole", "reversed").sortWithinPartitions("whole", "reversed")
    return near.mapInArrow(_solve, "whole boolean, word string, cost array<long>, edits array<string>")


def turns(conversations: DataFrame, copies: str | None = None) -> DataFrame:
    """The rows with what structure needs to know of them: (conv_id, turn, role, mark, n, blank, truncated, text). ``mark`` is the
    SHA-256 of the text; turns of one number are in order of role and mark. A null role or text counts as one space."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("n"))
    bare = F.rtrim("text", F.lit(BLANKS))
    return rows.select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("mark"), "n", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"), "text"
    )


def _order(*more: str) -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), *[F.col(c) for c in more], F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark")]


def marked(rows: DataFrame) -> DataFrame:
    """One row for each distinct turn, with ``n`` times it stands there and ``again``: whether an earlier turn of the
    conversation has its role and text. Equal rows are counted before they are dealt out."""
    one = rows.groupBy("conv_id", "turn", "role", "mark").agg(F.sum("n").alias("n"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = (
        one.where("n > 0").groupBy("conv_id", "role", "mark").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("places")).where("places > 1")
        .select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("mark").alias("_mark"), "first")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("mark") == F.col("_mark"))
    return one.join(first, same, "left").select("conv_id", "turn", "role", "mark", "n", "blank", "truncated", (F.col("first") < at).alias("later"))


_STRETCH = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("word", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
     ("first_role", pa.string()), ("last_role", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64())]
)
_STRETCH_DDL = "conv_id long, part long, whole boolean, word string, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, first_turn long, last_turn long, turns long"


class _Stretch:
    def __init__(self, conv, part):
        self.row = {"conv_id": conv, "part": part, "whole": False, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first_role": None, "last_role": None, "first_turn": None, "last_turn": None, "turns": 0}
        self.word: list[str] = []

    def add(self, turn, initial, fault):
        r = self.row
        self.word.append(symbols_of(initial, fault in ("blank", "duplicate"), fault == "truncated"))
        if fault:
            r[fault] += 1
        if r["first_role"] is None:
            r["first_role"] = initial
        else:
            r["illegal"] += r["last_role"] + initial not in ("su", "ua", "au")
        r["last_role"] = initial
        if turn is not None and turn != r["last_turn"]:
            r["turns"] += 1
            r["first_turn"] = turn if r["first_turn"] is None else r["first_turn"]
            r["last_turn"] = turn


def _stretches(batches, most):
    """Sorted turns to stretches. A conversation is whole if it lies within the task, not at its edges, and in one stretch."""
    part = now = None
    first = True
    for batch in batches:
        out = []
        cols = [batch.column(c).to_pylist() for c in ("conv_id", "task", "turn", "initial", "n", "blank", "truncated", "later")]
        for conv, task, turn, initial, n, blank, truncated, later in zip(*cols, strict=True):
            if now is None or now.row["conv_id"] != conv:
                if now is not None:
                    now.row["whole"], first = not first, False
                    out.append(now.row | {"word": "".join(now.word)})
                part = task << 33
                now = _Stretch(conv, part)
                cut = False
            for k in range(n):
                if len(now.word) == most:
                    out.append(now.row | {"word": "".join(now.word)})
                    part, cut = part + 1, True
                    now = _Stretch(conv, part)
                now.add(turn, initial, "blank" if blank else "duplicate" if later or k else "truncated" if truncated else "")
            if cut:
                first = True  # what follows of this conversation is no whole one
        yield pa.RecordBatch.from_pylist(out, _STRETCH)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.row | {"word": "".join(now.word)}], _STRETCH)


def stretches(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Words of conversations of at most ``stretch`` turns, with counts of faults. Turns are dealt out by ranges of conversation and place, so a
    conversation of any length is spread over tasks; a task holds one stretch at a time."""
    near = marked(rows).repartitionByRange(*_order()).sortWithinPartitions(*_order())
    wanted = near.select("conv_id", F.spark_partition_id().cast("long").alias("task"), "turn", F.left("role", F.lit(1)).alias("initial"), "n", "blank", "truncated", F.coalesce("later", F.lit(False)).alias("later"))
    return wanted.mapInArrow(partial(_stretches, most=stretch), _STRETCH_DDL)


def _joined(parts: list[dict]) -> dict:
    """A conversation from its stretches in order."""
    out = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
    last_role = last_turn = None
    first_turn, n_turns = None, 0
    best = {START: (0, "")}
    for p in parts:
        if p["first_role"] is not None:
            out["illegal"] += last_role is not None and last_role + p["first_role"] not in ("su", "ua", "au")
            last_role = p["last_role"]
        if p["turns"]:
            n_turns += p["turns"] - (p["first_turn"] == last_turn)
            first_turn, last_turn = (p["first_turn"] if first_turn is None else first_turn), p["last_turn"]
        if not p["whole"]:
            best = {b: min((c + p["cost"][4 * a + b], e + p["edits"][4 * a + b]) for a, (c, e) in best.items()) for b in STATES}
    out["gaps"] = last_turn - first_turn + 1 - n_turns if n_turns else 0
    out["cost"], out["audit"] = (parts[0]["cost"][0], parts[0]["edits"][0]) if parts[0]["whole"] else min(best[q] for q in ACCEPTING if q in best)
    return out


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_AUDIT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string())])


def _join_parts(batches):
    for batch in batches:
        out = []
        for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            out.append({"conv_id": conv} | _joined(sorted(parts, key=lambda p: p["part"])))
        yield pa.RecordBatch.from_pylist(out, _AUDIT)


def audits(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row for each conversation of :func:`turns`."""
    cut = materialize(stretches(rows, stretch), "stretches")
    known = solved(cut)
    each = cut.join(known, ["whole", "word"]).drop("word")
    parts = each.groupBy("conv_id").agg(F.collect_list(F.struct(*[c for c in each.columns if c != "conv_id"])).alias("parts"))
    return parts.mapInArrow(_join_parts, "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string")


class _Rebuilt:
    """Applies an audit to turns as they come, giving (role, text) of what stays, changes or is inserted."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            yield NEXT_ROLE[self.state], ""
            self.at, self.state = self.at + 1, NEXT_STATE[self.state]

    def take(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            yield role, text
            self.state = MOVES[self.state][role[0]]
        elif edit == "R":
            yield NEXT_ROLE[self.state], text
            self.state = NEXT_STATE[self.state]


def _apply(batches) -> Iterator[tuple[dict | None, Iterator[tuple[str, str]] | None]]:
    """The header of each conversation, followed by the repaired turns that each row gives; at the end those after it."""
    rebuilt = None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("conv_id", "head", "role", "text", "n")]
        for conv, head, role, text, n in zip(*cols, strict=True):
            if head is not None:
                if rebuilt:
                    yield None, rebuilt.inserted()
                rebuilt = _Rebuilt(head["audit"])
                yield {"conv_id": conv} | head, None
            else:
                for _ in range(n):
                    yield None, rebuilt.take(role, text)
    if rebuilt:
        yield None, rebuilt.inserted()


_REPAIR = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _hash(batches):
    now, sha, some, out = None, None, False, []
    for head, lines in _apply(batches):
        if head is not None:
            if now:
                out.append(now | {"repaired_sha256": sha.hexdigest()})
            now, sha, some = head, hashlib.sha256(), False
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, _REPAIR)
                out = []
        else:
            for role, text in lines:
                sha.update(f"\n{role}:{text}".encode() if some else f"{role}:{text}".encode())
                some = True
    if now:
        yield pa.RecordBatch.from_pylist([*out, now | {"repaired_sha256": sha.hexdigest()}], _REPAIR)


_TURN = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _rows(batches):
    conv, place, out, size = None, 0, [], 0
    for head, lines in _apply(batches):
        if head is not None:
            conv, place = head["conv_id"], 0
        else:
            for role, text in lines:
                out.append({"conv_id": conv, "place": place, "role": role, "text": text})
                place, size = place + 1, size + len(text) + 64
        if size > 1 << 20:
            yield pa.RecordBatch.from_pylist(out, _TURN)
            out, size = [], 0
    yield pa.RecordBatch.from_pylist(out, _TURN)


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit as a row of its own ahead of its turns in order. Texts move once; a task reads them as they come."""
    head = found.select("conv_id", F.lit(0).alias("line"), F.struct(*_COUNTS, "audit").alias("head"))
    lines = rows.where("n > 0").select("conv_id", F.lit(1).alias("line"), "turn", "role", "mark", "text", "n")
    both = head.unionByName(lines, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(*_order("line")).select("conv_id", "head", "role", "text", "n")


def repair(conversations: DataFrame, copies: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """One row for each conv_id: counts of gaps and faults, illegal neighbours, cost and audit of the cheapest edits, and
    ``repaired_sha256``, the hash of the repaired ``role:text`` lines.

    ``copies`` names a column that says how often a row stands there; 0 keeps its conversation in the result only. Turns
    go by number, null ones first, then by role and SHA-256 of the text; equal rows are duplicates of the first. A null
    conv_id is a conversation of its own; a null role or text is one space, so such a text is blank; an empty role has
    no initial and cannot be kept. Texts of any length are hashed as they are read. Other columns, whatever their names,
    are not read. An empty table gives no rows. A conversation of any length is solved in stretches over many tasks; only
    its hash, which can be formed in no other way, reads its turns one after the other.
    """
    rows = turns(conversations, copies)
    fields = ", ".join(f"{c} long" for c in _COUNTS)
    return _with_audits(rows, audits(rows, stretch)).mapInArrow(_hash, f"conv_id long, {fields}, audit string, repaired_sha256 string")


def repaired(conversations: DataFrame, copies: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """The repaired conversations: (conv_id, place, role, text), places from 0. Inputs as in :func:`repair`."""
    rows = turns(conversations, copies)
    return _with_audits(rows, audits(rows, stretch)).mapInArrow(_rows, "conv_id long, place long, role string, text string")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by a hash of (conv_id, turn): one in twenty each is dropped, emptied, stripped of its closing marks,
    repeated, or given to the user. ``copies`` says how often a row stands there."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.pmod(F.crc32(F.concat_ws(":", *spaced[:2]).cast("binary")), F.lit(20)).alias("kind")
    rows = conversations.select("conv_id", "turn", spaced[2].alias("role"), spaced[3].alias("text"), kind)
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _oracle() -> str:
    """DuckDB form of :func:`repair` of :func:`damage` over ``conversations``: costs and audits as one text, nine digits and
    the edits, so that the least text is the cheapest audit and of equal ones the first."""

    def add(cost: int, edit: str, rest: str) -> str:
        return f"(printf('%09d', CAST(left({rest}, 9) AS INTEGER) + {cost}) || '{edit}' || substr({rest}, 10))"

    def edits(q: int) -> str:
        keeps = " ".join(f"WHEN i = '{role}' THEN {add(0, 'K', f'b{to}')}" for role, to in MOVES[q].items())
        to = f"b{NEXT_STATE[q]}"
        kept = f"least(CASE {keeps} END, {add(REROLE, 'R', to)})"
        late = f"printf('%09d', CAST(left(kept, 9) AS INTEGER) + CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END) || substr(kept, 10)"
        gone = add(DELETE, "D", f"b{q}")
        return f"(SELECT CASE WHEN fault IN ('blank', 'duplicate') THEN {gone} ELSE least({gone}, {late}) END FROM (SELECT {kept} AS kept))"

    def inserted(q: int, n: int = 2) -> str:
        to = NEXT_STATE[q]
        return f"least(x{q}, {add(INSERT, 'I', inserted(to, n - 1))})" if n else f"x{q}"

    states = ", ".join
    return f"""
WITH RECURSIVE steps AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'),
        lambda h: CAST(('0x' || h) AS BIGINT))),
      lambda c, b: xor(c // 256, crc.t[xor(c % 256, b) + 1]))) % 20 AS kind
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS n
  FROM hashed),
placed AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS i,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos
  FROM damaged, range(2) t(c) WHERE c < n),
faulty AS (
  SELECT *, CASE
      WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
    lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS prev
  FROM placed),
ids AS (SELECT conv_id, count(*) AS rows_in FROM conversations GROUP BY conv_id),
sizes AS (
  SELECT ids.conv_id, count(f.pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pos > 1 AND prev || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ids LEFT JOIN faulty f ON ids.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY ids.conv_id),
togo AS (
  SELECT conv_id, n + 1 AS pos, '000000000' AS b0, '000000010II' AS b1, '000000005I' AS b2, '000000000' AS b3 FROM sizes
  UNION ALL
  SELECT conv_id, pos, {states(f"{inserted(q)} AS b{q}" for q in STATES)}
  FROM (SELECT t.conv_id, f.pos, {states(f"{edits(q)} AS x{q}" for q in STATES)}
        FROM togo t JOIN faulty f ON f.pos = t.pos - 1 AND f.conv_id IS NOT DISTINCT FROM t.conv_id)),
best AS (SELECT conv_id, CAST(left(b0, 9) AS BIGINT) AS cost, substr(b0, 10) AS audit FROM togo WHERE pos = 1),
walk AS (
  SELECT conv_id, audit, 0 AS j, 0 AS pos, 0 AS q, CAST(NULL AS VARCHAR) AS line FROM best
  UNION ALL
  SELECT w.conv_id, audit, j + 1, w.pos + CASE WHEN e = 'I' THEN 0 ELSE 1 END,
    CASE WHEN e = 'D' THEN q WHEN e = 'K' AND f.i = 's' THEN 1 WHEN q = 2 THEN 3 ELSE 2 END,
    CASE WHEN e = 'D' THEN NULL WHEN e = 'K' THEN f.role || ':' || f.text
      ELSE CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN e = 'R' THEN f.text ELSE '' END END
  FROM (SELECT *, substr(audit, CAST(j + 1 AS INTEGER), 1) AS e FROM walk WHERE j < length(audit)) w
  LEFT JOIN faulty f ON f.pos = w.pos + 1 AND f.conv_id IS NOT DISTINCT FROM w.conv_id),
texts AS (SELECT conv_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY j), '')) AS repaired_sha256 FROM walk GROUP BY conv_id)
SELECT s.conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256
FROM sizes s JOIN best b ON s.conv_id IS NOT DISTINCT FROM b.conv_id JOIN texts t ON s.conv_id IS NOT DISTINCT FROM t.conv_id
"""


ORACLE = _oracle()
