"""Order-dependent selections. A group is one film or transcript; what doesn't depend on earlier picks is computed before, in columns."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["project_id"]


def _in_line(df: DataFrame, keys, order: list[str]) -> DataFrame:
    """df, dealt by the keys and sorted by them and the order, with a column __in_line."""
    # Spark drops a repartition by keys by which the rows are dealt already, and may then deal them anew; it keeps to what a window asks for
    return df.withColumn("__in_line", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def _whole_groups(batches: Iterator[pd.DataFrame], keys) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Rows of whole groups, from batches in which groups stand side by side; and the rows at which the groups start and the last one ends."""
    def same(a, b) -> bool:
        return a == b or (pd.isna(a) and pd.isna(b))

    held: list[pd.DataFrame] = []  # pieces of one group
    for t in batches:
        if not len(t):
            continue
        new = np.zeros(len(t), dtype=bool)
        for k in keys:
            v, none = t[k].to_numpy(), t[k].isna().to_numpy()
            new[1:] |= ~((v[1:] == v[:-1]) | (none[1:] & none[:-1]))
        starts = np.flatnonzero(new).tolist()
        if held and not all(same(held[0][k].iloc[0], t[k].iloc[0]) for k in keys):
            starts = [0, *starts]
        if not starts:
            held.append(t)
            continue
        done = pd.concat([*held, t.iloc[: starts[0]]], ignore_index=True)
        if len(done):
            yield done, [0, len(done)]
        if len(starts) > 1:
            yield t.iloc[starts[0] : starts[-1]].reset_index(drop=True), [x - starts[0] for x in starts]
        held = [t.iloc[starts[-1] :].reset_index(drop=True)]
    if held:
        last = pd.concat(held, ignore_index=True)
        yield last, [0, len(last)]


def _grouped(df: DataFrame, keys: list[str], columns: list[str], added: str, decide, order: int = 1, kept: list[str] | None = None) -> DataFrame:
    """keys, columns (or only those `kept`) and the added ones. decide gets the columns of a group as lists, in the order of the first
    `order` columns, and returns a list, or a tuple with a list for each added column where there are several.

    Groups stand side by side in sorted partitions and are decided as they stream past, so small groups cost little and a task never
    holds more than a batch and a group.
    """
    slim = df.select(*keys, *columns)
    back = [*keys, *(columns if kept is None else kept)]
    schema = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in back)
    names = [a.split()[0] for a in added.split(", ")]

    def decided(t: pd.DataFrame, edges: list[int]) -> pd.DataFrame:
        lists = {c: t[c].tolist() for c in columns}
        out: dict[str, list] = {n: [] for n in names}
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            got = decide({c: v[x:y] for c, v in lists.items()})
            for n, values in zip(names, got if len(names) > 1 else [got], strict=True):
                out[n] += values
        return t.iloc[: edges[-1]][back].assign(**out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t, edges in _whole_groups(batches, keys):
            yield decided(t, edges)

    return _in_line(slim, keys, columns[:order]).mapInPandas(run, f"{schema}, {added}")


def segment_transcript(cues: DataFrame, max_seconds: float = 60.0, max_chars: int = 200, keys=KEYS) -> DataFrame:
    """keys, chunk_id, start_s, end_s, text, word_count (characters), source_entries of each chunk of cues (keys, pos, start_s, end_s, text).

    Blank cues are skipped. A chunk ends before a cue that would make it longer than max_seconds or max_chars; the first chunk starts
    with the first cue, blank or not.
    """
    opening = cues.groupBy(*keys).agg(F.min_by("start_s", "pos").alias("opening"))
    spoken = cues.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).where("text != ''")
    sized = spoken.withColumn("chars", F.char_length("text").cast("long")).join(opening, list(keys))

    def decide(g: dict) -> list:
        out, chunk, used, start = [], 0, 0, g["opening"][0]
        for s, e, c in zip(g["start_s"], g["end_s"], g["chars"], strict=True):
            if out and (e - start > max_seconds or used + c > max_chars):
                chunk, start, used = chunk + 1, s, 0
            used += c
            out.append(chunk)
        return out

    cut = _grouped(sized, keys, ["pos", "start_s", "end_s", "chars", "opening"], "chunk int", decide).select(*keys, "pos", "chunk")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    start = F.when(F.col("chunk") == 0, F.min("opening")).otherwise(F.min_by("start_s", "pos"))
    return sized.join(cut, [*keys, "pos"]).groupBy(*keys, "chunk").agg(start.alias("start_s"), F.max_by("end_s", "pos").alias("end_s"), text.alias("text"), F.sum("chars").alias("word_count"), F.count("*").alias("source_entries")).select(*keys, F.format_string("chunk-%04d", "chunk").alias("chunk_id"), "start_s", "end_s", "text", "word_count", "source_entries")


def _cut(starts: list[float], ends: list[float], heard: list[float], min_seconds: float, max_seconds: float) -> tuple[list, ...]:
    """has_break, seq, first_s, scenes and closes (see _sequenced) of a film's scenes in their order. heard: the sorted starts of its cues."""
    out: tuple[list, ...] = ([], [], [], [], [])
    has_break, seqs, firsts, counts, closes = (x.append for x in out)
    seq, count, start, first = 0, 0, 0.0, 0.0
    for s, e, ahead in zip(starts, ends, [*starts, None][1:], strict=True):
        b = False
        if ahead is not None and ahead == ahead:  # else the last scene, or one before a scene without a start
            at = bisect_right(heard, ahead + 1)
            b = not (at and heard[at - 1] >= e - 1)
        if not count:
            start = first = s
        elif s < first or first != first:
            first = s
        count += 1
        over = e - start >= max_seconds or (e - start >= min_seconds and b)
        has_break(b)
        seqs(seq)
        firsts(first)
        counts(count)
        closes(over or ahead is None)
        if over:
            seq, count = seq + 1, 0
    return out


def _sequenced(scenes: DataFrame, cues: DataFrame, min_seconds: float, max_seconds: float, keys) -> DataFrame:
    """keys, kind (1), pos, start_s, end_s, has_break, seq of each scene, and of its sequence up to it: first_s, the least start; scenes, their
    number; closes, whether it is the last one.

    A film's starts of cues and then its scenes pass as one line of numbers that is dealt and sorted once, so no scene waits in a second sort
    or a join, and a sequence needs no aggregate. A scene finds the last cue before its gap's end by bisection.
    """
    def decide(g: dict) -> tuple[list, ...]:
        n = g["kind"].count(0)  # cues, which stand in front
        cut = _cut(g["start_s"][n:], g["end_s"][n:], g["start_s"][:n], min_seconds, max_seconds)
        return tuple([none] * n + of_scenes for none, of_scenes in zip((False, 0, 0.0, 0, False), cut, strict=True))

    number = lambda c: F.col(c).cast("double").alias(c)
    of_scenes = scenes.select(*keys, F.lit(1).alias("kind"), "pos", number("start_s"), number("end_s"))
    no_pos = F.lit(0).cast(scenes.schema["pos"].dataType).alias("pos")  # not null, so that pandas keeps whole numbers
    of_cues = cues.select(*keys, F.lit(0).alias("kind"), no_pos, number("start_s"), F.lit(None).cast("double").alias("end_s")).where("start_s is not null and not isnan(start_s)")
    cut = _grouped(of_scenes.unionByName(of_cues), keys, ["kind", "pos", "start_s", "end_s"], "has_break boolean, seq int, first_s double, scenes bigint, closes boolean", decide, order=3)
    kinds = {"start_s": "start_s", "end_s": "end_s", "first_s": "start_s"}
    return cut.where("kind = 1").withColumns({c: F.col(c).cast(scenes.schema[of].dataType) for c, of in kinds.items()})


def number_sequences(scenes: DataFrame, cues: DataFrame, min_seconds: float = 45.0, max_seconds: float = 120.0, keys=KEYS) -> DataFrame:
    """keys, pos, start_s, end_s, has_break, seq of each scene: its sequence's number. A sequence ends with a scene at max_seconds, at a break
    of the dialogue from min_seconds on, or with the last scene; the next one starts where the next scene does. has_break: no cue starts
    between a second before the scene's end and a second after the next scene's start. The last scene has none."""
    return _sequenced(scenes, cues, min_seconds, max_seconds, keys).select(*keys, "pos", "start_s", "end_s", "has_break", "seq")


def cluster_scenes(scenes: DataFrame, cues: DataFrame, min_seconds: float = 45.0, max_seconds: float = 120.0, keys=KEYS) -> DataFrame:
    """Sequences of scenes: keys, sequence_id, start_s, end_s, scenes."""
    cut = _sequenced(scenes, cues, min_seconds, max_seconds, keys).where("closes")
    return cut.select(*keys, F.format_string("seq-%03d", "seq").alias("sequence_id"), F.col("first_s").alias("start_s"), "end_s", "scenes")


#: Bytes of transcripts that a task gathers before it hands them on.
HANDED_ON = 4 << 20


def _overlaps(starts: list[float], ends: list[float], scenes: list[tuple[float, float]]) -> list[list[int]]:
    """Of each scene (s, e), the cues that share more than a point with it, in their order. Both may overlap and start in any order, one without
    a start or an end shares nothing. Scenes are met by their starts, with the cues that are open then on a heap."""
    order = sorted((i for i, (s, e) in enumerate(zip(starts, ends, strict=True)) if s == s and e == e), key=starts.__getitem__)
    at = [starts[i] for i in order]
    found: list[list[int]] = [[] for _ in scenes]
    opened: list[tuple[float, int]] = []
    k = 0
    for j in sorted((j for j, (s, e) in enumerate(scenes) if s == s and e == e), key=lambda j: scenes[j][0]):
        s, e = scenes[j]
        while k < len(at) and at[k] <= s:
            heappush(opened, (ends[order[k]], order[k]))
            k += 1
        while opened and opened[0][0] <= s:
            heappop(opened)
        found[j] = sorted([i for _, i in opened if starts[i] < e] + [i for i in order[k : bisect_left(at, e, k)] if ends[i] > s])
    return found


def sequence_rollup(scenes: DataFrame, cues: DataFrame, min_seconds: float = 45.0, max_seconds: float = 120.0, keys=KEYS) -> DataFrame:
    """keys, sequence_id, start_s, end_s, transcript, characters, keyframes, dialogue_count of the sequences that number_sequences numbers.

    scenes: keys, pos, start_s, end_s; cues: keys, cue_pos, start_s, end_s, text. Scenes may have a transcript, or with `spoken` (boolean) that
    of the texts of the cues that they overlap, joined by spaces in cue order; both sides may have characters as an array, and a scene has
    those of the cues that it overlaps besides its own; scenes may have keyframes as an array. What is null or missing counts as none.

    The transcript joins the scenes' own, or where they have none the texts of the cues that start within 0.2 s of the sequence; characters
    are distinct and sorted, keyframes distinct and in order; the dialogue count is that of the cues, or of the transcripts where there is no
    cue. A row whose keys are null meets no other one.

    A long cue is a part of every scene that it overlaps, so transcripts can be many times the cues' texts. They are never shuffled: a film's
    cues and then its scenes pass as one line that is dealt and sorted once, each text in it once, and a transcript is made when its sequence
    closes. A task holds a batch, one film's rows and the transcripts that it hands on next.
    """
    def rolled(g: dict, joins: bool) -> Iterator[tuple]:
        n = g["kind"].count(0)  # cues, which stand in front
        starts, ends = g["start_s"], g["end_s"]
        heard = sorted(s for s in starts[:n] if s == s)
        _, seqs, firsts, counts, closes = _cut(starts[n:], ends[n:], heard, min_seconds, max_seconds)
        met = n if joins else 0
        overlapped = _overlaps(starts[:met], ends[:met], list(zip(starts[n:], ends[n:], strict=True)))
        in_time = sorted((i for i in range(met) if starts[i] == starts[i]), key=starts.__getitem__)
        times = [starts[i] for i in in_time]
        for last, seq, first, count, closing in zip(range(n, len(starts)), seqs, firsts, counts, closes, strict=True):
            if not closing:
                continue
            own, names, frames = [], set(), {}
            for i in range(last - count + 1, last + 1) if joins else ():
                over = overlapped[i - n]
                text = g["text"][i]
                if text is None and g["spoken"][i]:
                    text = b" ".join(g["text"][c] for c in over if g["text"][c] is not None)
                if text is not None and (text := text.strip(b" ")):
                    own.append(text)
                for c in (i, *over):
                    if g["characters"][c] is not None:
                        names.update(x for x in g["characters"][c] if x)
                if g["keyframes"][i] is not None:
                    frames.update((x, None) for x in g["keyframes"][i] if x)
            near = sorted(in_time[bisect_left(times, first - 0.2) : bisect_right(times, ends[last] + 0.2)]) if first == first and ends[last] == ends[last] else []
            own = own or [g["text"][c] for c in near if g["text"][c]]
            yield seq, first, ends[last], b" ".join(own), sorted(names), list(frames), len(near) or len(own)

    of_seqs = ["seq", "first_s", "end_s", "transcript", "characters", "keyframes", "dialogue_count"]
    columns = ["kind", "start_s", "end_s", "text", "spoken", "characters", "keyframes"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t, edges in _whole_groups(batches, keys):
            lists, nameless = {c: t[c].tolist() for c in columns}, t[list(keys)].isna().any(axis=1).tolist()
            rows, out, gathered = [], [], 0
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                for r in rolled({c: v[x:y] for c, v in lists.items()}, not nameless[x]):
                    rows.append(x)
                    out.append(r)
                    gathered += len(r[3])
                    if gathered >= HANDED_ON:
                        yield pd.concat([t.loc[rows, list(keys)].reset_index(drop=True), pd.DataFrame(out, columns=of_seqs)], axis=1)
                        rows, out, gathered = [], [], 0
            if out:
                yield pd.concat([t.loc[rows, list(keys)].reset_index(drop=True), pd.DataFrame(out, columns=of_seqs)], axis=1)

    def side(df: DataFrame, kind: int, **places) -> DataFrame:
        given = lambda c, of: (F.col(c) if c in df.columns else F.lit(None)).cast(of).alias(c)
        text = "text" if kind == 0 else "transcript"
        return df.select(*keys, F.lit(kind).alias("kind"), *(p.alias(c) for c, p in places.items()), given("start_s", "double"), given("end_s", "double"), given(text, "binary").alias("text"), F.coalesce(given("spoken", "boolean"), F.lit(False)).alias("spoken"), given("characters", "array<string>"), given("keyframes", "array<string>"))

    no_pos, no_cue_pos = F.lit(None).cast(scenes.schema["pos"].dataType), F.lit(None).cast(cues.schema["cue_pos"].dataType)
    line = side(cues, 0, pos=no_pos, cue_pos=F.col("cue_pos")).unionByName(side(scenes, 1, pos=F.col("pos"), cue_pos=no_cue_pos))
    dealt = _in_line(line, keys, ["kind", "pos", "cue_pos", "start_s", "text"]).select(*keys, *columns, "__in_line")
    of_keys = ", ".join(f"`{k}` {line.schema[k].dataType.simpleString()}" for k in keys)
    cut = dealt.mapInPandas(run, f"{of_keys}, seq int, first_s double, end_s double, transcript binary, characters array<string>, keyframes array<string>, dialogue_count bigint")
    span = [F.col(c).cast(scenes.schema[of].dataType).alias(of) for c, of in (("first_s", "start_s"), ("end_s", "end_s"))]
    return cut.select(*keys, F.format_string("seq-%03d", "seq").alias("sequence_id"), *span, F.col("transcript").cast("string").alias("transcript"), "characters", "keyframes", "dialogue_count")


#: The share of the target length that each part of the story gets.
PHASE_SHARES = {"setup": 0.22, "inciting_incident": 0.26, "investigation": 0.28, "climax": 0.16, "resolution": 0.08}


def select_phases(sequences: DataFrame, target_seconds: float, keys=KEYS) -> DataFrame:
    """The picked rows of sequences (keys, pos, start_s, duration_s, event_type, weight, is_main) with their part of the story and their
    place: 1, 2, ... by (start_s, pos) over the whole selection of a project. Parts are independent, so a group is one part of one project.

    Candidates go by falling weight, the earlier first among equals; the first opening of the setup (before 300 s, weight 7 or more) goes
    before them all. A candidate is taken unless it starts within 30 s of a pick, is no main story though something is picked, or takes the
    part beyond 1.3 times its budget though something is picked; the opening is always taken. A pick that reaches the budget is the last.
    Types beside the five parts count as investigation.
    """
    part = F.when(F.col("event_type").isin(*PHASE_SHARES), F.col("event_type")).otherwise("investigation")
    budget = F.element_at(F.create_map(*(F.lit(x) for kv in PHASE_SHARES.items() for x in kv)), F.col("part")) * target_seconds
    group = W.partitionBy(*keys, "part")
    may_open = (F.col("part") == "setup") & (F.col("start_s") < 300) & (F.col("weight") >= 7)
    rows = sequences.withColumn("part", part).withColumn("budget", budget).withColumn("__may", may_open)
    rows = rows.withColumn("__nth", F.row_number().over(group.orderBy(F.desc("__may"), F.desc("weight"), "pos"))).withColumn("opens", F.col("__may") & (F.col("__nth") == 1))
    rows = rows.withColumn("turn", F.row_number().over(group.orderBy(F.desc("opens"), F.desc("weight"), "pos")))

    def decide(g: dict) -> list:
        taken: list[float] = []
        room, full, out = g["budget"][0] * 1.30, False, []
        left = g["budget"][0]
        for start, length, main, opens in zip(g["start_s"], g["duration_s"], g["is_main"], g["opens"], strict=True):
            free = not taken or (main and length <= room and min(abs(start - t) for t in taken) >= 30)
            out.append(opens or (free and not full))
            if out[-1]:
                taken.append(start)
                room, left = room - length, left - length
                full = full or (left <= 0 and not opens)
        return out

    picked = _grouped(rows, [*keys, "part"], ["turn", "pos", "start_s", "duration_s", "weight", "is_main", "budget", "opens"], "picked boolean", decide)
    in_time = W.partitionBy(*keys).orderBy("start_s", "pos")
    return picked.where("picked").select(*keys, "part", "pos", "start_s", "duration_s", "weight", "is_main", F.row_number().over(in_time).alias("place"))


def label_topics(scores: DataFrame, phases: DataFrame, keys=KEYS) -> DataFrame:
    """keys, pos, topic: the unused topic of the highest score from 2 on (the first among equals), else the part of the story with the
    row's position. scores: keys, pos, topic_no, topic, score (vetoed topics left out); phases: keys, pos, phase."""
    w = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "topic_no", "topic")))
    ranked = scores.where("score >= 2").groupBy(*keys, "pos").agg(F.transform(w, lambda x: x["topic"]).alias("topics"))
    rows = phases.join(ranked, [*keys, "pos"], "left")

    def decide(g: dict) -> list:
        used, out = set(), []
        for pos, phase, topics in zip(g["pos"], g["phase"], g["topics"], strict=True):
            free = [t for t in (topics if topics is not None else ()) if t not in used]
            out.append(free[0] if free else f"phase_{phase}_{pos}")
            used.add(out[-1])
        return out

    return _grouped(rows, keys, ["pos", "phase", "topics"], "topic string", decide).select(*keys, "pos", "topic")


#: What narrations and scenes have in common, as arrays of strings: words, words of the scene's summary, concepts.
SHARED = ("tokens", "summary", "concepts")


def _listed(of_scenes: list) -> dict[str, list[int]]:
    """The inverted list of each term: the numbers of the scenes that hold it."""
    lists = defaultdict(list)
    for i, terms in enumerate(of_scenes):
        for x in set(terms) if terms is not None else ():
            lists[x].append(i)
    return lists


def _common(lists: dict[str, list[int]], terms: set, scenes: int) -> np.ndarray:
    """How many of the terms each scene holds."""
    n = np.zeros(scenes)
    for x in terms:
        if x in lists:
            n[lists[x]] += 1
    return n


def plan_clips(narrations: DataFrame, scenes: DataFrame, total_seconds: float, spacing: float = 8.0, aligned: bool = False, keys=KEYS) -> DataFrame:
    """keys, pos, source_start, source_end, scene_pos, score: a stretch of the source for each narration, in order.

    narrations: keys, pos, need, anchor, proposed_start, proposed_end (null without a proposal); scenes: keys, scene_pos, start_s. Both may
    have tokens and concepts, scenes also summary, as arrays of strings; what is null or missing is shared by none, and repeated terms count
    once. With `aligned`, proposals are followed as they are. Else the scene with the best score is taken, the earlier among equals: 0.30
    times the concepts, 0.20 times the tokens and 0.15 times the words of the summary that it shares, 0.25 times its place and 0.10 times the
    order (as in `matching.affinity`), rounded to 4 places. A proposal counts unless it lies outside the source, within 15 s of a pick, more
    than 120 s behind the last one, or starts where an earlier one did; the place is then 40 s around it. Scenes within `spacing` of a pick
    are left out while others are there; without scenes the anchor is taken, with score 0. Starts are kept inside the source.

    Scenes and narrations are dealt and sorted once, a project's scenes before its narrations, and never paired in a join: shared terms are
    counted by the inverted lists of the project's scenes. A task holds a batch and one project's rows, each once.
    """
    span, reach = max(120.0, 0.25 * total_seconds), max(1.0, 0.1 * total_seconds)

    def places(start: np.ndarray, anchor: float, window: tuple[float, float] | None) -> np.ndarray:
        if window is None:
            return np.maximum(0, 1 - np.abs(start - anchor) / span)
        low, high = window
        return np.where((start >= low - 30) & (start <= high + 30), 1.0, -2 - np.minimum(np.abs(start - low), np.abs(start - high)) / 100)

    def orders(start: np.ndarray, last: float | None) -> np.ndarray:
        if last is None:
            return np.full(len(start), 0.5)
        d = start - last
        return np.where(d >= 0, np.minimum(1, 0.5 + 0.5 * (1 - np.minimum(1, d / reach))), np.where(d >= -30, 0.2, -1 - np.abs(d) / 100))

    def decide(g: dict) -> list:
        n = g["kind"].count(0)  # scenes, which stand in front
        numbers, start = g["at"][:n], np.asarray(g["start"][:n], dtype=float)
        tokens_of, summary_of, concepts_of = (_listed(g[c][:n]) for c in SHARED)
        used, proposals, out = [], set(), [None] * n
        for need, anchor, low, high, tokens, concepts in zip(*(g[c][n:] for c in ("need", "start", "low", "high", "tokens", "concepts")), strict=True):
            tokens, concepts = (set(x) if x is not None else set() for x in (tokens, concepts))
            last = used[-1] if used else None
            window = None
            proposed = low is not None and not np.isnan(low)
            if proposed:
                loops = last is not None and last > 0 and low < last - 120
                if 0 <= low <= total_seconds and not loops and low not in proposals and all(abs(low - u) >= 15 for u in used):
                    window = (low - 40, high + 40)
                proposals.add(low)
            if aligned and proposed:
                chosen, scene, score = low, None, 1.0
            elif not n:
                chosen, scene, score = anchor, None, 0.0
            else:
                met = _common(concepts_of, concepts, n)
                c = np.where(met > 0, np.minimum(1.0, 0.6 + 0.4 * (met - 1)), 0.0)
                t = np.minimum(1.0, _common(tokens_of, tokens, n) / max(3.0, 0.15 * len(tokens)))
                u = np.minimum(1.0, _common(summary_of, tokens, n) / max(4.0, 0.20 * len(tokens)))
                scores = np.floor((0.30 * c + 0.20 * t + 0.15 * u + 0.25 * places(start, anchor, window) + 0.10 * orders(start, last)) * 10_000 + 0.5) / 10_000
                free = np.ones(n, dtype=bool)
                for u in used:
                    free &= np.abs(start - u) >= spacing
                best = int(np.argmax(np.where(free | ~free.any(), scores, -np.inf)))
                chosen, scene, score = float(start[best]), int(numbers[best]), float(scores[best])
            chosen = max(0.0, min(chosen, max(0.0, total_seconds - need)))
            used.append(chosen)
            out.append((chosen, scene, score))
        return out

    def side(df: DataFrame, kind: int, at: str, **numbers) -> DataFrame:
        doubles = [numbers.get(c, F.lit(None)).cast("double").alias(c) for c in ("start", "need", "low", "high")]
        shared = [(F.col(c) if c in df.columns else F.lit(None)).cast("array<string>").alias(c) for c in SHARED]
        return df.select(*keys, F.lit(kind).alias("kind"), F.col(at).cast("bigint").alias("at"), *doubles, *shared)

    line = side(scenes, 0, "scene_pos", start=F.col("start_s")).unionByName(side(narrations, 1, "pos", start=F.col("anchor"), need=F.col("need"), low=F.col("proposed_start"), high=F.col("proposed_end")))
    picked = _grouped(line, keys, ["kind", "at", "start", "need", "low", "high", *SHARED], "pick struct<start:double,scene:int,score:double>", decide, order=2, kept=["kind", "at", "need"])
    pos = F.col("at").cast(narrations.schema["pos"].dataType).alias("pos")
    return picked.where("kind = 1").select(*keys, pos, F.col("pick.start").alias("source_start"), (F.col("pick.start") + F.col("need")).alias("source_end"), F.col("pick.scene").alias("scene_pos"), F.col("pick.score").alias("score"))
