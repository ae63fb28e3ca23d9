"""Chat formatting by minimum-cost role repair.

A legal conversation is ``[system] (user assistant)+``. Its automaton has a state for the role last
written. Dynamic programming over the turns finds the cheapest way to a legal sequence: a turn may keep its role
(free), take another (``RELABEL``), join the turn written before it, if that has its role (``MERGE``),
and an empty turn may be put before it or at the end (``INSERT``). Of equal costs the one that changes
fewer labels wins, then the one that merges less, then the role that comes first in ``ROLES``, settled
from the last turn back. No text is lost. The repaired sequence is then rendered.

The repair depends on roles alone, so it is kept by role sequence; texts go through one exchange by
conversation, and a conversation must fit in a task.

Defined results: turns are read by ``turn`` (nulls last), then ``role`` and ``text``; repeated rows
are turns of their own; null texts are empty; a null or unknown role can't be kept, only
relabelled; usual other names of roles (``ALIASES``, any case) are read as the role. Null ``conv_id`` is one
conversation. Marks inside a text are broken by a space, so that no text can pose as a turn.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import column, need

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
MERGE, RELABEL, INSERT = 10, 20, 25
#: Legal next roles; state 3 is the start. Index: roles as in ``ROLES``.
NEXT = {3: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
END = 2


@lru_cache(None)
def _fill(a: int, b: int) -> tuple[int, ...] | None:
    """Fewest roles to write between state ``a`` and a turn of role ``b``; None: there is no way."""
    paths, seen = [(a, ())], {a}
    while paths:
        new = []
        for s, path in paths:
            if b in NEXT[s]:
                return path
            for t in NEXT[s]:
                if t not in seen:
                    seen.add(t)
                    new.append((t, (*path, t)))
        paths = new
    return None


@lru_cache(100_000)
def repair(roles: tuple[int, ...], merge: int = MERGE, relabel: int = RELABEL, insert: int = INSERT) -> tuple[int, tuple[tuple[int, tuple[int, ...]], ...]]:
    """Cost, and the legal sequence as (role, places of the turns joined in it); ``roles`` are places in ``ROLES``, -1 unknown."""
    if not roles:
        return 0, ()
    # by state: (cost, relabels, merges), and the step that led there: (state before, roles filled in, merged)
    best: list[dict[int, tuple[tuple[int, int, int], tuple | None]]] = [{3: ((0, 0, 0), None)}]
    for r in roles:
        here: dict[int, tuple] = {}
        for s in sorted(best[-1]):
            (c, n, m), _ = best[-1][s]
            for t in range(len(ROLES)):
                changed = t != r
                c2, n2 = c + relabel * changed, n + changed
                ways = [] if s != t else [((c2 + merge, n2, m + 1), (s, (), True))]
                if (fill := _fill(s, t)) is not None:
                    ways.append(((c2 + insert * len(fill), n2, m), (s, fill, False)))
                for cost, step in ways:
                    if t not in here or cost < here[t][0]:
                        here[t] = (cost, step)
        best.append(here)
    tails = {s: () if s == END else (*_fill(s, END), END) for s in best[-1]}
    total, s = min(((v[0][0] + insert * len(tails[s]), *v[0][1:]), s) for s, v in best[-1].items())
    out = [(t, ()) for t in reversed(tails[s])]
    joined: list[int] = []
    for i in range(len(roles), 0, -1):
        before, fill, merged = best[i][s][1]
        joined.append(i - 1)
        if not merged:
            out.append((s, tuple(reversed(joined))))
            out += [(t, ()) for t in reversed(fill)]
            joined = []
        s = before
    return total[0], tuple(reversed(out))


def role_of(role: str | None) -> int:
    r = (role or "").strip().lower()
    r = ALIASES.get(r, r)
    return ROLES.index(r) if r in ROLES else -1


def render(sequence, texts: list[str]) -> str:
    return "".join(f"<|{ROLES[r]}|>\n" + "\n".join(texts[i].replace("<|", "< |") for i in own) + "<|end|>\n" for r, own in sequence)


def _format(batches: Iterable[pa.RecordBatch], costs: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    names: dict[str | None, int] = {}
    for b in batches:
        if not b.num_rows:
            continue
        turns = column(b, "turns")
        flat, ends = turns.flatten(), turns.offsets.to_pylist()
        roles, texts = flat.field("role").to_pylist(), flat.field("text").fill_null("").to_pylist()
        out = []
        for a, z in zip(ends[:-1], ends[1:]):
            a, z = a - ends[0], z - ends[0]
            own = tuple(names[r] if r in names else names.setdefault(r, role_of(r)) for r in roles[a:z])
            cost, sequence = repair(own, *costs)
            relabelled = sum(own[i] != r for r, group in sequence for i in group)
            filled = sum(not group for _, group in sequence)
            out.append((z - a, len(sequence), cost, z - a - (len(sequence) - filled), relabelled, filled, render(sequence, texts[a:z])))
        n, m, cost, merged, relabelled, filled, text = zip(*out)
        yield pa.record_batch([column(b, "conv_id"), *(pa.array(x, pa.int32()) for x in (n, m, cost, merged, relabelled, filled)), pa.array(text, pa.string())], names=["conv_id", "turns_in", "turns_out", "cost", "merged", "relabelled", "inserted", "rendered"])


def formatted(conversations: DataFrame, merge: int = MERGE, relabel: int = RELABEL, insert: int = INSERT) -> DataFrame:
    """``conv_id, turns_in, turns_out, cost, merged, relabelled, inserted, rendered``, one row for each conversation."""
    ship(conversations.sparkSession)
    rows = need(conversations, "conv_id", "turn", "role", "text")
    turn = F.struct(F.col("turn").isNull().alias("none"), "turn", "role", "text")
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    turns = turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return turns.mapInArrow(lambda it: _format(it, (merge, relabel, insert)), "conv_id long, turns_in int, turns_out int, cost int, merged int, relabelled int, inserted int, rendered string")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _sql(merge: int = MERGE, relabel: int = RELABEL, insert: int = INSERT) -> str:
    """The same dynamic programming as a recursive query, a round for each turn, the text written along the way."""
    mark = lambda r: f"<|{ROLES[r]}|>\n"
    empty = lambda rs: "'" + "".join(mark(r) + "<|end|>\n" for r in rs) + "'"
    steps = [f"({s}, {t}, 1, {insert * len(f)}, {len(f)}, {empty(f)})" for s in (3, 0, 1, 2) for t in range(3) if (f := _fill(s, t)) is not None]
    steps += [f"({t}, {t}, 0, {merge}, 0, '')" for t in range(3)]
    tails = {s: () if s == END else (*_fill(s, END), END) for s in range(3)}
    ends = [f"({s}, {insert * len(t)}, {len(t)}, {empty(t)})" for s, t in tails.items()]
    role = "CASE lower(trim(role)) " + " ".join(f"WHEN '{k}' THEN {ROLES.index(v)}" for k, v in [*ALIASES.items(), *zip(ROLES, ROLES)]) + " ELSE -1 END"
    key = "cost * 1000000000000 + n * 100000000 + m * 10000 + s * 10 + way"
    names = "CASE t " + " ".join(f"WHEN {t} THEN '{mark(t)}'" for t in range(3)) + " END"
    return f"""WITH RECURSIVE c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS i, {role} AS r, replace(coalesce(text, ''), '<|', '< |') AS x FROM conversations),
    w AS (SELECT * FROM (VALUES {", ".join(steps)}) v(s, t, way, price, fills, fill)), e AS (SELECT * FROM (VALUES {", ".join(ends)}) v(s, price, fills, fill)),
    d AS (SELECT conv_id, 0::BIGINT AS i, 3 AS s, 0::BIGINT AS cost, 0::BIGINT AS n, 0::BIGINT AS m, 0::BIGINT AS filled, '' AS doc FROM (SELECT DISTINCT conv_id FROM conversations)
      UNION ALL SELECT conv_id, i, t AS s, b.cost, b.n, b.m, b.filled, b.doc FROM (SELECT conv_id, i, t, arg_min(struct_pack(cost := cost, n := n, m := m, filled := filled, doc := doc), {key}) AS b
        FROM (SELECT d.conv_id, c.i, w.t, d.s, w.way, d.cost + w.price + CASE WHEN w.t <> c.r THEN {relabel} ELSE 0 END AS cost, d.n + CASE WHEN w.t <> c.r THEN 1 ELSE 0 END AS n, d.m + 1 - w.way AS m, d.filled + w.fills AS filled,
          CASE WHEN w.way = 0 THEN d.doc || '\n' || c.x ELSE d.doc || CASE WHEN d.i > 0 THEN '<|end|>\n' ELSE '' END || w.fill || {names.replace("CASE t", "CASE w.t")} || c.x END AS doc
          FROM d JOIN c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.i = d.i + 1 JOIN w ON w.s = d.s) GROUP BY conv_id, i, t)),
    z AS (SELECT conv_id, max(i) AS k FROM c GROUP BY conv_id),
    f AS (SELECT d.conv_id, z.k, arg_min(struct_pack(cost := d.cost + e.price, n := d.n, m := d.m, filled := d.filled + e.fills, doc := d.doc || '<|end|>\n' || e.fill), (d.cost + e.price) * 1000000000000 + d.n * 100000000 + d.m * 10000 + d.s) AS b
      FROM d JOIN z ON z.conv_id IS NOT DISTINCT FROM d.conv_id AND z.k = d.i JOIN e ON e.s = d.s GROUP BY d.conv_id, z.k)
    SELECT conv_id, k::INT AS turns_in, (k - b.m + b.filled)::INT AS turns_out, b.cost::INT AS cost, b.m::INT AS merged, b.n::INT AS relabelled, b.filled::INT AS inserted, b.doc AS rendered FROM f"""


SQL = _sql()
