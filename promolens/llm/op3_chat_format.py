"""Roles of transcript lines by a hidden Markov model, and canonical turn rendering.

States are (role, first line of a turn or not). A line is seen as its speaker marker (one of ``MARKERS``, another
``Word:``, or none), its length class, its last and its first character's kind, and whether an input row begins with
it. The counts of starts, transitions and
features are taken over labelled turns in one Spark aggregate of bounded size (states times feature values).
Decoding is Viterbi. A transcript is cut into parts of ``TURNS`` of its turn numbers; each part yields the best
path score from every entry to every exit state (a max-plus matrix), the parts of a transcript are joined by these
small matrices, and every part is decoded between its entry and exit. So one long transcript is many tasks and the
result is that of one pass.

Input: conv_id, turn, text (transcript pieces, may hold several lines). Rows without text give no line; rows of a
null conv_id form one transcript; rows without turn come first, in a part of their own. Rows of one turn number are
ordered by text. Result: a row per recovered turn, under the part and number where it opens; what goes on in later
parts is joined to it, so the cut into parts never shows. Rendered text is that of the lines, blank ones too; only a line that opens a turn loses a marker of ``MARKERS``.
Blank lines follow the line before them (those that open a part, the first line with it) and are not decoded or counted
in n_lines; a part of blank lines only gives no row. All roles count: the counts grow with the number of roles, the
matrices with its square. Where no role could be learned every input row is a turn of null role, with its markers.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promolens.llm.staging import stage, table

TURNS, PACK_ROWS, SMOOTH = 64, 4000, 0.1
#: Share of a state's lines that counts as seen at either place in a row, so that rows of several turns, and turns of
#: several rows, stay possible where the labelled ones have none.
PLACE_SHARE = 0.02
#: Speaker markers by kind, and a canonical turn.
MARKERS = (("user", "human", "question", "q", "customer"), ("assistant", "ai", "bot", "answer", "a", "agent"), ("system", "instruction", "context"))
TURN = "<|{role}|>\n{text}\n<|end|>\n"
_MARK = re.compile(r"^\s*(?:#+\s*|\*\*|\[|<\|?)?([A-Za-z]{1,12})(?:\*\*|\]|\|?>)?\s*:\s*|^\s*###\s*([A-Za-z]{1,12})\s*$")
SIZES = (len(MARKERS) + 2, 8, 6, 4, 2)
PLACE = len(SIZES) - 1


def features(line: str, first: bool) -> tuple[tuple[int, ...], str]:
    """Feature values of a line, ``first`` if its row begins with it, and the line without its marker."""
    m, kind, body = _MARK.match(line), 0, line
    if m:
        word = (m[1] or m[2]).lower()
        kind = next((i + 1 for i, names in enumerate(MARKERS) if word in names), len(MARKERS) + 1)
        if kind <= len(MARKERS):
            body = line[m.end():]
    s = body.strip()
    last = {"?": 1, ".": 2, "!": 3, ":": 4}.get(s[-1:], 0 if s else 5)
    head = 3 if not s else 0 if s[0].isupper() else 1 if s[0].isalpha() else 2
    return (kind, min(7, len(s).bit_length() * 7 // 12), last, head, int(first)), body


def lines_of(text: str | None) -> list[str]:
    return [x for x in text.split("\n") if x.strip()] if text else []


def with_blanks(texts: list[str]) -> list[tuple[str, str, str, bool]]:
    """(line, before, after, first) of consecutive texts: the blank lines after each line, those before the very first,
    and whether the line is the first of its text."""
    out, ahead = [], ""
    for text in texts:
        first = True
        for x in text.split("\n") if text else ():
            if x.strip():
                out.append([x, "" if out else ahead, "", first])
                first = False
            elif out:
                out[-1][2] += "\n" + x
            else:
                ahead += x + "\n"
    return [tuple(x) for x in out]


class Hmm:
    def __init__(self, roles: list[str], counts: dict):
        self.roles = roles
        k = self.k = max(1, 2 * len(roles))
        logs = lambda x: np.log((x + SMOOTH) / (x + SMOOTH).sum(-1, keepdims=True))
        step = np.zeros((k + 1, k))
        seen = [np.zeros((k, n)) for n in SIZES]
        for (what, a, b), n in counts.items():
            if what == "step":
                step[a, b] += n
            else:
                seen[int(what)][a, b] += n
        allowed = np.ones((k + 1, k), bool)
        for s in range(k):  # a turn's later line follows a line of the same role
            if s % 2:
                allowed[:, s] = False
                allowed[[s - 1, s], s] = True
        self.step = np.where(allowed, logs(step), -1e9)
        seen[PLACE] += PLACE_SHARE * seen[PLACE].sum(1, keepdims=True)
        self.seen = [logs(s) for s in seen]

    def emitted(self, values: np.ndarray) -> np.ndarray:
        return sum((s[:, values[:, i]] for i, s in enumerate(self.seen)), np.zeros((self.k, len(values)))).T

    def across(self, e: np.ndarray) -> np.ndarray:
        """Best scores from every entry (the state before, or k for none) to every last state."""
        m = self.step + e[0]
        for t in range(1, len(e)):
            if self.k > 32:  # one entry at a time: bounded by the square of the states
                m = np.stack([(x[:, None] + self.step[: self.k]).max(0) for x in m]) + e[t]
            else:
                m = (m[:, :, None] + self.step[None, : self.k]).max(1) + e[t]
        return m

    def path(self, e: np.ndarray, entry: int, leave: int) -> np.ndarray:
        v, back = self.step[entry] + e[0], np.zeros((len(e), self.k), np.int64)
        for t in range(1, len(e)):
            x = v[:, None] + self.step[: self.k]
            back[t] = x.argmax(0)
            v = x.max(0) + e[t]
        out = np.empty(len(e), np.int64)
        out[-1] = leave
        for t in range(len(e) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out


def learned(turns: DataFrame) -> Hmm:
    """``turns`` with role; null roles and texts are left out."""
    known = turns.where("role is not null and text is not null")
    roles = sorted(r[0] for r in known.select("role").distinct().collect())
    place = {role: 2 * i for i, role in enumerate(roles)}

    def count(batches):
        total: dict = {}
        for batch in batches:
            for role, after, more, text in zip(*(batch.column(c).to_pylist() for c in ("role", "after", "more", "text"))):
                here = place[role]
                before = place[after] + more if after is not None else 2 * len(roles)
                for i, line in enumerate(lines_of(text)):
                    now = here + (i > 0)
                    for key in (("step", before, now), *((str(f), now, v) for f, v in enumerate(features(line, i == 0)[0]))):
                        total[key] = total.get(key, 0) + 1
                    before = now
        yield pa.record_batch([
            pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int32()),
            pa.array([k[2] for k in total], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["what", "a", "b", "n"])

    # the state that the turn before ends in (its role, and whether it has more lines than one), by equi-join on the turn number
    n = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"(?U)\S")))
    ended = known.where("turn is not null").select("conv_id", (F.col("turn") + 1).alias("turn"), "role", n.alias("n")).where("n > 0")
    past = ended.groupBy("conv_id", "turn").agg(F.max(F.struct("role", F.col("n") > 1)).alias("s"))
    past = past.select("conv_id", "turn", F.col("s.role").alias("after"), F.col("s.col2").cast("int").alias("more"))
    pairs = known.join(past, ["conv_id", "turn"], "left").select("role", "after", "more", "text")
    got = pairs.mapInArrow(count, "what string, a int, b int, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    return Hmm(roles, {tuple(r[:3]): r[3] for r in got})


def formatted(pieces: DataFrame, model: Hmm) -> DataFrame:
    """conv_id, part, turn (number within the part), role, n_lines, rendered."""
    spark = pieces.sparkSession
    hmm = spark.sparkContext.broadcast(model)
    part = F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(2**62))).cast("long")
    rows = pieces.where("text is not null").select("conv_id", part.alias("part"), "turn", "text")
    packs = max(8, -(-rows.count() // PACK_ROWS))
    rows = rows.withColumn("pack", F.pmod(F.xxhash64("conv_id", "part"), F.lit(packs)))

    def parts(t: pa.Table):
        """(conv_id, part, lines with their blank ones) of a pack."""
        order = [(x is not None, x or 0, y, z is not None, z or 0, w) for x, y, z, w in zip(*(t.column(c).to_pylist() for c in ("conv_id", "part", "turn", "text")))]
        order.sort()
        key, held = None, []
        for has, conv, p, _, _, text in order:
            now = (conv if has else None, p)
            if now != key:
                if lines := with_blanks(held):
                    yield *key, lines
                held = []
            key = now
            held.append(text)
        if lines := with_blanks(held):
            yield *key, lines

    def score(t: pa.Table) -> pa.Table:
        m = hmm.value
        got = [(c, p, m.across(m.emitted(np.array([features(x[0], x[3])[0] for x in lines]))).tobytes()) for c, p, lines in parts(t)]
        return pa.table({"conv_id": pa.array([g[0] for g in got], pa.int64()), "part": pa.array([g[1] for g in got], pa.int64()), "m": pa.array([g[2] for g in got], pa.binary())})

    def joined(t: pa.Table) -> pa.Table:
        m = hmm.value
        by: dict = {}
        for c, p, x in zip(*(t.column(c).to_pylist() for c in ("conv_id", "part", "m"))):
            by.setdefault(c, []).append((p, np.frombuffer(x).reshape(m.k + 1, m.k)))
        out = []
        for conv, own in by.items():
            own.sort(key=lambda x: x[0])
            v, back = None, []
            for _, x in own:
                both = x[m.k][None, :] if v is None else v[:, None] + x[: m.k]
                back.append(both.argmax(0))
                v = both.max(0)
            leave = int(v.argmax())
            for i in range(len(own) - 1, -1, -1):
                entry = int(back[i][leave]) if i else m.k
                out.append((conv, own[i][0], entry, leave))
                leave = entry
        return pa.table({n: pa.array([o[i] for o in out], pa.int64()) for i, n in enumerate(("conv_id", "part", "entry", "leave"))})

    def decode(t: pa.Table, ends: pa.Table) -> pa.Table:
        m = hmm.value
        at = {(c, p): (a, b) for c, p, a, b in zip(*(ends.column(c).to_pylist() for c in ("conv_id", "part", "entry", "leave")))} if ends.num_rows else {}
        out: list[tuple] = []
        for conv, p, lines in parts(t) if t.num_rows else ():
            entry, leave = at[conv, p]
            seen = [features(x[0], x[3]) for x in lines]
            states = m.path(m.emitted(np.array([s[0] for s in seen])), entry, leave)
            n = 0
            cuts = [i for i, s in enumerate(states) if i == 0 or s % 2 == 0] + [len(states)]
            for a, b in zip(cuts, cuts[1:]):
                role = m.roles[int(states[a]) // 2]
                # the marker goes where the line opens a turn, and nowhere else
                own = [seen[a][1] if states[a] % 2 == 0 else lines[a][0], *(x[0] for x in lines[a + 1: b])]
                text = "\n".join(before + x + after for x, (_, before, after, _) in zip(own, lines[a:b]))
                out.append((conv, p, n, role, bool(states[a] % 2) and entry < m.k, b - a, text))
                n += 1
        return turn_table(out)

    def apart(t: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for conv, p, lines in parts(t):
            cuts = [i for i, x in enumerate(lines) if x[3]] + [len(lines)]
            for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                text = "\n".join(before + x + after for x, before, after, _ in lines[a:b])
                out.append((conv, p, n, None, False, b - a, text))
        return turn_table(out)

    def turn_table(out: list[tuple]) -> pa.Table:
        kinds = (("conv_id", pa.int64()), ("part", pa.int64()), ("turn", pa.int32()), ("role", pa.string()), ("continued", pa.bool_()), ("n_lines", pa.int32()), ("text", pa.string()))
        return pa.table({n: pa.array([o[i] for o in out], k) for i, (n, k) in enumerate(kinds)})

    turns = "conv_id long, part long, turn int, role string, continued boolean, n_lines int, text string"
    if not model.roles:
        return rendered(rows.groupBy("pack").applyInArrow(apart, turns))
    scores = rows.groupBy("pack").applyInArrow(score, "conv_id long, part long, m binary")
    # one group per hash of conv_id: the small matrices of a transcript meet in order
    ends = scores.groupBy(F.pmod(F.xxhash64("conv_id"), F.lit(packs)).alias("h")).applyInArrow(joined, "conv_id long, part long, entry long, leave long")
    ends = stage(ends, "ends").withColumn("pack", F.pmod(F.xxhash64("conv_id", "part"), F.lit(packs)))
    return rendered(whole_turns(stage(rows.groupBy("pack").cogroup(ends.groupBy("pack")).applyInArrow(decode, turns), "turns")))


def whole_turns(turns: DataFrame) -> DataFrame:
    """What goes on from the part before is joined to the turn that opened it.

    Only a part's first turn can go on, so one small row a part tells where each was opened; other turns are not
    shuffled.
    """
    parts = turns.groupBy("conv_id", "part").agg(F.max("turn").alias("last"), F.max("continued").alias("goes_on"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    opens = ~F.col("goes_on") | (F.col("last") > 0)
    opened = parts.withColumn("at", F.last(F.when(opens, F.struct("part", "last")), ignorenulls=True).over(before)).where(
        "goes_on and at is not null").select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "at")
    here = turns["conv_id"].eqNullSafe(opened["c"]) & (turns["part"] == opened["p"])
    later = turns.where("continued").join(opened, here).select(
        "conv_id", F.col("at.part").alias("part"), F.col("at.last").alias("turn"), F.array_sort(F.array(F.struct(F.col("part").alias("p"), "n_lines", "text"))).alias("more"))
    later = later.groupBy("conv_id", "part", "turn").agg(F.array_sort(F.flatten(F.collect_list("more"))).alias("more")).select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("turn").alias("t"), "more")
    heads = turns.where("not continued")
    same = heads["conv_id"].eqNullSafe(later["c"]) & (heads["part"] == later["p"]) & (heads["turn"] == later["t"])
    none = F.array().cast("array<struct<p:bigint,n_lines:int,text:string>>")
    more = F.coalesce("more", none)
    return heads.join(later, same, "left").select(
        "conv_id", "part", "turn", "role",
        F.aggregate(more, F.col("n_lines"), lambda n, x: n + x["n_lines"]).alias("n_lines"),
        F.array_join(F.concat(F.array("text"), F.transform(more, lambda x: x["text"])), "\n").alias("text"))


def rendered(turns: DataFrame) -> DataFrame:
    opening, closing = TURN.split("{text}")
    head = F.replace(F.lit(opening), F.lit("{role}"), F.coalesce("role", F.lit("")))
    return turns.select("conv_id", "part", "turn", "role", "n_lines", F.concat(head, "text", F.lit(closing)).alias("rendered"))


def transcripts(turns: DataFrame) -> DataFrame:
    """Turns as a transcript writes them: two of three open with a speaker marker, in a style of the conversation;
    no role column."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(3))
    index = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).when(F.col("role") == "system", 2)
    name = F.element_at(F.array(*[F.array(*[F.lit(names[s]) for s in range(3)]) for names in MARKERS]), index + 1)
    mark = F.concat(F.initcap(F.element_at(name, style.cast("int") + 1)), F.lit(": "))
    marked = (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) < 2) & index.isNotNull()
    return turns.withColumn("text", F.when(marked, F.concat(mark, "text")).otherwise(F.col("text")))


def op3_chat_format(spark, base: str) -> DataFrame:
    """Transcripts are derived from the turns of ``conversations``; the model is learned from all that have a role."""
    turns = transcripts(table(spark, base, "conversations").select("conv_id", "turn", "role", "text"))
    return formatted(turns.drop("role"), learned(turns))
