"""Repair of the structure of conversations: the cheapest edits that give a system turn at most, then pairs of user and assistant.

The grammar `(s?(ua)+)?` has four states: nothing yet, after a system, after a user, after an assistant turn; the first and the last may
end. A forward Viterbi pass over the turns of one conversation keeps, for each state, the least (cost, audit string). At each turn its layer
takes one edit of the turn (Keep, Rerole, Delete), and is closed with the inserts that lead from state to state: two are enough, since
more of them come back to where they were. An audit string determines its path, so of two ways into a state with the same cost the
ASCII-least goes on; no such string begins with another, as the longer one would have inserts more and cost more.

Spark brings the turns of a conversation together in order, and a task passes them by in Arrow batches, conversation after conversation. A
state carries the hash of its repaired text, not the text, and the beginning that all states share leaves their audit strings, so
that one conversation with very many turns needs its own audit string and little more. Which turns repeat earlier ones is known before,
from a window within the conversation.

Defined results: a null role or text is one space, and so is a null turn in the damage's key; null conv_ids are one conversation; turns
order with nulls first, then (equal turns) by role and text as damaged; a role without a character is illegal next to any; repeated rows
are as many turns, the later ones duplicates; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: More for a truncated turn that stays.
TRUNCATED = 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: The states from which each state may be entered.
FROM = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
INITIAL = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}
NAME = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Turns after which the beginning that all states share is moved out of their strings.
SETTLE = 64
BLANKS = r"\x20\x09-\x0D"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
FAULTS = ("blank", "duplicate", "truncated")


@dataclass(frozen=True)
class Path:
    cost: int
    audit: str
    sha: object  # of the repaired text so far; None: nothing yet

    def step(self, letter: str, more: int, line: Callable[[], bytes] | None) -> tuple[int, str, Path, Callable[[], bytes] | None]:
        return self.cost + COST[letter] + more, self.audit + letter, self, line


def _taken(step: tuple[int, str, Path, Callable[[], bytes] | None]) -> Path:
    """Only the best step into a state hashes its line."""
    cost, audit, before, line = step
    sha = before.sha
    if line is not None:
        if sha is None:
            sha = hashlib.sha256(line())
        else:
            sha = sha.copy()
            sha.update(b"\n" + line())
    return Path(cost, audit, sha)


def _least(*steps):
    found = [s for s in steps if s is not None]
    return min(found, key=lambda s: s[:2]) if found else None


class Viterbi:
    """One conversation, fed with its turns in order."""

    def __init__(self) -> None:
        self.settled: list[str] = []
        self.turns = 0
        self.layer: list[Path | None] = self._closed([Path(0, "", None), None, None, None])

    def _closed(self, layer: list[Path | None]) -> list[Path | None]:
        """Inserts: into the user state from any other, then into the assistant state from that of the user."""
        for state in (USER, ASSISTANT):
            text = f"{NAME[state]}:".encode()
            old = layer[state]
            step = _least(*(layer[x].step(INSERT, 0, lambda: text) for x in FROM[state] if layer[x] is not None))
            if step is not None and (old is None or step[:2] < (old.cost, old.audit)):
                layer[state] = _taken(step)
        return layer

    def feed(self, role: str, text: str, fault: str | None) -> None:
        initial, more = role[:1], TRUNCATED if fault == "truncated" else 0
        must_go = fault in ("blank", "duplicate")
        layer: list[Path | None] = [None] * 4
        for state in range(4):
            own = self.layer[state]
            steps = [own.step(DELETE, 0, None) if own is not None else None]
            keeps = state != START and initial == INITIAL[state]
            if not must_go and (keeps or state in NAME):
                letter, named = (KEEP, role) if keeps else (REROLE, NAME[state])
                line = lambda named=named: f"{named}:{text}".encode()
                steps += [self.layer[x].step(letter, more, line) for x in FROM[state] if self.layer[x] is not None]
            best = _least(*steps)
            layer[state] = best and _taken(best)
        self.layer = self._closed(layer)
        self.turns += 1
        if self.turns % SETTLE == 0:
            self._settle()

    def _settle(self) -> None:
        # what goes on from a state costs at most one deleted system turn more from the assistant's, which may end; one that is dearer is lost
        end = self.layer[ASSISTANT]
        for state, room in ((START, COST[DELETE]), (SYSTEM, 0)):
            if self.layer[state] is not None and self.layer[state].cost > end.cost + room:
                self.layer[state] = None
        live = [p for p in self.layer if p is not None]
        n = 0
        for letters in zip(*(p.audit for p in live), strict=False):
            if len(set(letters)) > 1:
                break
            n += 1
        self.settled.append(live[0].audit[:n])
        self.layer = [p and Path(p.cost, p.audit[n:], p.sha) for p in self.layer]

    def result(self) -> tuple[int, str, str]:
        """cost, audit, hash of the repaired conversation."""
        best = min((p for p in (self.layer[START], self.layer[ASSISTANT]) if p is not None), key=lambda p: (p.cost, p.audit))
        return best.cost, "".join(self.settled) + best.audit, (best.sha or hashlib.sha256(b"")).hexdigest()


class Conversation:
    """The whole row of one conversation; `there` is false for a turn that the damage dropped."""

    def __init__(self) -> None:
        self.best, self.counts, self.illegal, self.initial = Viterbi(), dict.fromkeys(FAULTS, 0), 0, None
        self.least = self.most = None
        self.distinct = 0

    def feed(self, there: bool, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if not there:
            return
        if turn is not None:
            self.distinct += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial
        self.best.feed(role, text, fault)

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        cost, audit, sha = self.best.result()
        return (gaps, *(self.counts[f] for f in FAULTS), self.illegal, cost, audit, sha)


def damaged(conversations: DataFrame) -> DataFrame:
    """c, turn, role, text, there: the rows of `conversations` as damaged by crc32(conv_id:turn) % 20; a dropped row stays as a mark."""
    one = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    rows = conversations.select(F.col("conv_id").alias("c"), "turn", one("role").alias("role"), one("text").alias("text"), way.alias("w"))
    text = F.when(F.col("w") == 1, "").when(F.col("w") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("w") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.select("c", "turn", F.when(F.col("w") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("w") != 0).alias("there"), F.explode(times).alias("_again"))
    return rows.drop("_again")


def fault_of(role_and_text_seen: Column) -> Column:
    """The first fault of a turn, or null."""
    blank = ~F.col("text").rlike(f"[^{BLANKS}]")
    cut = ~F.col("text").rlike(rf"[.!?][{BLANKS}]*\z")
    return F.when(~F.col("there"), None).when(blank, "blank").when(role_and_text_seen, "duplicate").when(cut, "truncated")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RESULT.split(", ")]
    types = [*[pa.int64()] * 7, pa.string(), pa.string()]
    now, own = None, None

    def pack(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], names=names)

    for batch in batches:
        done = []
        for c, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if own is None or c != now:
                if own is not None:
                    done.append((now, *own.row()))
                now, own = c, Conversation()
            own.feed(*row)
        yield pack(done)
    if own is not None:
        yield pack([(now, *own.row())])


def repair(rows: DataFrame) -> DataFrame:
    """rows: c, turn, role, text, there (see damaged). A row for each c: its faults and the cheapest repair."""
    kept = rows.repartition("c")  # the window's key holds c, so it adds no exchange
    seen = Window.partitionBy("c", "there", "role", F.md5("text")).orderBy(F.asc_nulls_first("turn"))
    marked = kept.withColumn("nth", F.row_number().over(seen)).withColumn("fault", fault_of(F.col("nth") > 1))
    ordered = marked.sortWithinPartitions(F.asc_nulls_first("c"), F.asc_nulls_first("turn"), "role", "text", "nth")
    return ordered.select("c", "there", "turn", "role", "text", "fault").mapInArrow(_repaired, RESULT)


def _sql() -> str:
    from signalwright.llm.convtrie import CRC_SQL

    state = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    line = lambda role, text: f"coalesce({{p}}.t || chr(10), '') || {role} || ':' || {text}"

    def step(p: str, letter: str, more: str, text: str | None) -> str:
        new = text.format(p=p) if text else f"{p}.t"
        return f"CASE WHEN {p} IS NOT NULL THEN {{'c': {p}.c + {COST[letter]} + {more}, 'a': {p}.a || '{letter}', 't': {new}}}::{state} END"

    least = lambda *steps: f"list_aggregate([{', '.join(steps)}], 'min')"
    into = lambda ps, i, name: [step(p, x, "more", line(named, "text")).replace("THEN {", f"AND NOT must_go AND {cond} THEN {{", 1) for p in ps for x, named, cond in ((KEEP, "role", f"ini = '{i}'"), *(((REROLE, f"'{name}'", f"ini <> '{i}'"),) if name else ()))]
    gone = lambda p: step(p, DELETE, "0", None)
    insert = lambda p, name: step(p, INSERT, "0", line(f"'{name}'", "''"))
    return f"""WITH RECURSIVE w AS (SELECT conv_id AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC_SQL.format(x="(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS w FROM conversations),
d AS (SELECT c, turn, CASE WHEN w = 4 THEN 'user' ELSE role END AS role, CASE WHEN w = 1 THEN '' WHEN w = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN w = 3 THEN [1, 2] ELSE [1] END) AS again FROM w WHERE w <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, again) AS i FROM d),
f AS (SELECT *, role[1:1] AS ini, CASE WHEN NOT regexp_matches(text, '[^{BLANKS}]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][{BLANKS}]*\\z') THEN 'truncated' END AS fault FROM o),
e AS (SELECT c, i, role, text, ini, coalesce(fault IN ('blank', 'duplicate'), false) AS must_go, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS more FROM f),
v AS (SELECT c, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': NULL}}::{state} AS p0, NULL::{state} AS p1, {{'c': 5, 'a': 'I', 't': 'user:'}}::{state} AS p2, {{'c': 10, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}}::{state} AS p3 FROM (SELECT DISTINCT c FROM w)
  UNION ALL
  SELECT c, i, q0, q1, m2, {least("q3", insert("m2", "assistant"))} FROM (SELECT *, {least("q2", insert("q0", "user"), insert("q1", "user"), insert("q3", "user"))} AS m2 FROM (
    SELECT e.c, e.i, {gone("p0")} AS q0, {least(gone("p1"), *into(["p0"], "s", None))} AS q1, {least(gone("p2"), *into(["p0", "p1", "p3"], "u", "user"))} AS q2, {least(gone("p3"), *into(["p2"], "a", "assistant"))} AS q3
    FROM v JOIN e ON e.c IS NOT DISTINCT FROM v.c AND e.i = v.i + 1))),
z AS (SELECT c, {least("p0", "p3")} AS b FROM v QUALIFY row_number() OVER (PARTITION BY c ORDER BY i DESC) = 1),
g AS (SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE was || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(ini) OVER (PARTITION BY c ORDER BY i) AS was FROM f) GROUP BY c)
SELECT z.c AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.c AS cost, b.a AS audit, sha256(coalesce(b.t, '')) AS repaired_sha256
FROM z LEFT JOIN g ON g.c IS NOT DISTINCT FROM z.c"""


SQL = _sql()
