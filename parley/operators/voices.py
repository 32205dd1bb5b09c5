"""Voice vectors: centroids, exact nearest person, speaker clustering and identity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.functions.vectors import MAX_DISTANCE, cosine_similarity
from parley.operators.numbering import dense_number, greatest, written
from parley.operators.timeline import nearest

# fixed values: clustering limits
MERGE_THRESHOLD, CLUSTER_THRESHOLD = 0.5, 0.55
LONGEST_TURNS, MIN_TURN_SECS = 3, 1.5


def mean_vector(rows: DataFrame, keys: str | list[str], vector: str = "embedding") -> DataFrame:
    """Element-wise mean per key: keys, centroid."""
    keys = [keys] if isinstance(keys, str) else keys
    each = rows.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"].cast("float")).alias("centroid"))


def longest_turns(turns: DataFrame, keys: list[str], *, most: int = LONGEST_TURNS, least_secs: float = MIN_TURN_SECS) -> DataFrame:
    """Per key the few longest turns of at least ``least_secs``; the earlier wins ties."""
    secs = F.col("end") - F.col("start")
    order = W.partitionBy(*keys).orderBy(secs.desc(), F.col("turn_idx"))
    return turns.filter(secs >= least_secs).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def speaker_centroids(turns: DataFrame, key: str = "meeting_id", *, most: int = LONGEST_TURNS, least_secs: float = MIN_TURN_SECS) -> DataFrame:
    """Mean embedding of each speaker's longest turns; speakers without one are left out."""
    return mean_vector(longest_turns(turns, [key, "speaker_num"], most=most, least_secs=least_secs), [key, "speaker_num"])


def _units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay zero."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


#: Pivots, and the vectors they are chosen from.
PIVOTS, PIVOT_SAMPLE = 64, 2048
#: Angles are compared with this much room for rounding.
_SLACK = 1e-5
#: Distances this close are equal, so that the least id wins whatever block a vector stands in.
_DIGITS = 12


def choose_pivots(people: DataFrame, *, most: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """At most ``most`` directions that lie far apart, from a bounded sample of the vectors ``v`` (its choice changes cost, not results)."""
    held = people.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow().column("v").to_pylist()
    units = _units(np.array(held, dtype=np.float64)) if held else np.zeros((0, 1))
    units = units[np.linalg.norm(units, axis=1) > 0]
    chosen = list(range(min(1, len(units))))
    close = units @ units[0] if chosen else None
    while chosen and len(chosen) < most and close.min() < 1 - 1e-9:
        chosen.append(int(close.argmin()))
        close = np.maximum(close, units @ units[chosen[-1]])
    return units[chosen]


def _cells(known: DataFrame, most: int, block: int) -> int:
    """Pivots for a table: cells far smaller than a block only cost tasks."""
    return max(1, min(most, 4 * known.count() // block))


def _place(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` (id, v, rank) with the nearest pivot ``cell`` (-1 for a zero vector, which has no direction) and the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = _units(np.array(batch.column(1).to_pylist(), dtype=np.float64))
                close = np.clip(units @ pivots.T, -1, 1)
                cell = close.argmax(axis=1)
                angle = np.arccos(close[np.arange(len(cell)), cell])
                cell[np.linalg.norm(units, axis=1) == 0] = -1
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], ["id", "v", "rank", "cell", "angle"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id long, v {kinds['v']}, rank long, cell int, angle double")


def _blocked(placed: DataFrame, size: int) -> DataFrame:
    """``placed`` with ``block``: a cell's rows are dealt by id into as many blocks as hold about ``size`` each."""
    counts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("_parts"))  # a row for each pivot
    return placed.join(F.broadcast(counts), "cell").withColumn("block", F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("_parts"))).drop("_parts")


def block_pairs(asked: DataFrame, known: DataFrame, pivots: np.ndarray, *, others_only: bool, earlier: bool, max_distance: float) -> DataFrame:
    """q_block, p_block, n_q, n_p, needed: pairs of blocks, and whether a nearest person can be in them.

    An angle to a pivot is a bound: a person of a cell is at least the
    difference of the two angles to its pivot away, and at most their sum. A
    block of queries needs those people's blocks whose least possible angle is not above the most that its queries' nearest person can have.
    """
    n = len(pivots)

    def spread(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        angles = np.arccos(np.clip(_units(np.array(rows.column("v").to_pylist(), dtype=np.float64)) @ pivots.T, -1, 1))
        zero = key[0].as_py() < 0
        low, high = (np.zeros(n), np.full(n, np.inf)) if zero else (angles.min(axis=0), angles.max(axis=0))
        return pa.table({"q_block": pa.array([key[0].as_py()] * n, pa.int64()), "cell": pa.array(range(n), pa.int32()), "low": low, "high": high, "n_q": pa.array([rows.num_rows] * n, pa.int64())})

    queries = asked.select("block", "v").groupBy("block").applyInArrow(spread, "q_block long, cell int, low double, high double, n_q long")
    people = known.groupBy(F.col("block").alias("p_block"), "cell").agg(F.count(F.lit(1)).alias("n_p"), F.min("angle").alias("near"), F.max("angle").alias("far"))
    least = F.greatest(F.lit(0.0), F.col("low") - F.col("far"), F.col("near") - F.col("high"))
    met = queries.join(people, "cell").withColumn("least", least)
    cap = float(np.arccos(np.clip(1 - max_distance, -1, 1)))
    sure = F.lit(np.inf) if earlier else F.when(F.col("n_p") > 1, F.col("high") + F.col("far")).otherwise(np.inf) if others_only else F.col("high") + F.col("near")
    most = met.groupBy("q_block").agg(F.least(F.min(sure), F.lit(cap)).alias("most"))
    pairs = met.join(most, "q_block").select("q_block", "p_block", "n_q", "n_p", (F.col("least") <= F.col("most") + _SLACK).alias("needed"))
    # people without a direction are at distance 1 from everyone
    lost = known.filter("cell < 0").groupBy(F.col("block").alias("p_block")).agg(F.count(F.lit(1)).alias("n_p"))
    return pairs.unionByName(queries.filter("cell = 0").select("q_block", "n_q", F.lit(-1).alias("_k")).join(lost.withColumn("_k", F.lit(-1)), "_k").select("q_block", "p_block", "n_q", "n_p", F.lit(True).alias("needed")))


def nearest_person(queries: DataFrame, people: DataFrame, *, query_id: str = "query_id", vector: str = "embedding", person_vector: str = "voice_embedding", max_distance: float = MAX_DISTANCE, block: int = 2048, others_only: bool = False, earlier: bool = False, pivots: int = PIVOTS) -> DataFrame:
    """query_id, person_id, distance of the exact nearest person under ``max_distance`` (least id on ties).

    With ``others_only`` a person of the query's own id is passed over; with
    ``earlier``, all people whose column ``rank`` is not below the query's.
    Both sides are dealt by their nearest pivot into blocks of about ``block``
    vectors; pairs of blocks that the bounds leave are a keyed join, and each
    pair is one task's matrix. Rows without a vector are left out.
    """
    rank = F.col("rank").cast("long") if earlier else F.lit(None).cast("long")
    known = people.select(F.col("id").cast("long").alias("id"), F.col(person_vector).alias("v"), rank.alias("rank")).filter("v is not null")
    asked = queries.select(F.col(query_id).cast("long").alias("id"), F.col(vector).alias("v"), rank.alias("rank")).filter("v is not null")
    centres = choose_pivots(known.select("id", "v"), most=_cells(known, pivots, block))
    if not len(centres):  # no person has a direction: one cell
        size = known.select(F.size("v")).first()
        if size is None:
            return known.sparkSession.createDataFrame([], "query_id long, person_id long, distance double")
        centres = np.eye(1, size[0])
    p, q = _blocked(_place(known, centres), block), _blocked(_place(asked, centres), block)
    needed = written(block_pairs(q, p, centres, others_only=others_only, earlier=earlier, max_distance=max_distance).filter("needed").select("q_block", "p_block"))
    pair = F.struct("q_block", "p_block").alias("pair")
    left = q.withColumnRenamed("block", "q_block").join(needed, "q_block").select(pair, "id", "v", "rank")
    right = p.withColumnRenamed("block", "p_block").join(needed, "p_block").select(pair, "id", "v", "rank")

    def best(key: tuple[pa.Scalar], one: pa.Table, two: pa.Table) -> pa.Table:
        out = {"query_id": pa.array([], pa.int64()), "person_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())}
        if one.num_rows and two.num_rows:
            ids, person = one.column("id").to_numpy(), two.column("id").to_numpy()
            order = np.argsort(person, kind="stable")
            units = [_units(np.array(t.column("v").to_pylist(), dtype=np.float64)) for t in (one, two)]
            distance = np.round(1 - units[0] @ units[1][order].T, _DIGITS)
            if others_only:
                distance[ids[:, None] == person[order][None, :]] = np.inf
            if earlier:
                distance[two.column("rank").to_numpy()[order][None, :] >= one.column("rank").to_numpy()[:, None]] = np.inf
            at = distance.argmin(axis=1)
            least = distance[np.arange(len(ids)), at]
            hit = least < max_distance
            out = {"query_id": pa.array(ids[hit]), "person_id": pa.array(person[order][at[hit]]), "distance": pa.array(least[hit])}
        return pa.table(out)

    found = left.groupBy("pair").cogroup(right.groupBy("pair")).applyInArrow(best, "query_id long, person_id long, distance double")
    return found.groupBy("query_id").agg(F.min_by("person_id", F.struct("distance", "person_id")).alias("person_id"), F.min("distance").alias("distance"))


def share_skipped(queries: DataFrame, people: DataFrame, *, query_id: str = "query_id", vector: str = "embedding", person_vector: str = "voice_embedding", max_distance: float = MAX_DISTANCE, block: int = 2048, others_only: bool = False, pivots: int = PIVOTS) -> DataFrame:
    """One row: distances of the full product, those that ``nearest_person`` computes, and the share it skips."""
    known = people.select(F.col("id").cast("long").alias("id"), F.col(person_vector).alias("v"), F.lit(None).cast("long").alias("rank")).filter("v is not null")
    asked = queries.select(F.col(query_id).cast("long").alias("id"), F.col(vector).alias("v"), F.lit(None).cast("long").alias("rank")).filter("v is not null")
    centres = choose_pivots(known.select("id", "v"), most=_cells(known, pivots, block))
    p, q = _blocked(_place(known, centres), block), _blocked(_place(asked, centres), block)
    pairs = block_pairs(q, p, centres, others_only=others_only, earlier=False, max_distance=max_distance)
    every, done = F.sum(F.col("n_q") * F.col("n_p")), F.coalesce(F.sum(F.when(F.col("needed"), F.col("n_q") * F.col("n_p"))), F.lit(0))
    return pairs.agg(every.alias("every"), done.alias("computed"), (1 - done / every).alias("skipped"))


def similar_pairs(rows: DataFrame, key: str, id_: str, vector: Column, *, least: float = -1.0) -> DataFrame:
    """key, a, b, similarity of all pairs a < b within a key (one meeting's speakers)."""
    one = rows.select(F.col(key), F.col(id_).alias("a"), vector.alias("_va"))
    two = rows.select(F.col(key), F.col(id_).alias("b"), vector.alias("_vb"))
    pairs = one.join(two, key).filter("a < b").withColumn("similarity", cosine_similarity(F.col("_va"), F.col("_vb")))
    return pairs.filter(F.col("similarity") >= least).select(key, "a", "b", "similarity")


def agglomerate(centroids: list[np.ndarray], weights: list[float], threshold: float = MERGE_THRESHOLD) -> list[int]:
    """Group of each cluster after merging the closest pair while it reaches the threshold.

    The last of equally close pairs (in scan order) is merged; the merged
    centroid is the weighted mean, kept in single precision, at the first one's
    place. Each cluster keeps its best later partner; a merge compares the merged cluster
    with the others once, and looks again only for those whose partner it was or took away.
    """
    n = len(centroids)
    vectors, mass = np.array(centroids, dtype=np.float32), list(map(float, weights))
    if not n:
        return []
    units, alive, members = _units(vectors.astype(np.float64)), np.ones(n, dtype=bool), [[i] for i in range(n)]
    best, partner = np.full(n, -np.inf), np.full(n, -1)

    def look(i: int) -> None:
        """The last of the best partners after ``i``."""
        close = np.where(alive[i + 1 :], np.round(units[i + 1 :] @ units[i], _DIGITS), -np.inf)
        best[i], partner[i] = -np.inf, -1
        if len(close) and (top := close.max()) > -np.inf:
            best[i], partner[i] = top, i + 1 + np.flatnonzero(close == top)[-1]

    for i in range(n):
        look(i)
    while True:
        top = best.max()
        if top < threshold or top == -np.inf:
            break
        a = int(np.flatnonzero(best == top)[-1])
        b = int(partner[a])
        both = mass[a] + mass[b]
        vectors[a] = ((vectors[a].astype(np.float64) * mass[a] + vectors[b].astype(np.float64) * mass[b]) / both).astype(np.float32)
        units[a] = _units(vectors[a : a + 1].astype(np.float64))[0]
        mass[a] = both
        members[a] += members[b]
        alive[b], best[b], partner[b] = False, -np.inf, -1
        before = np.flatnonzero(alive[:a])
        close = np.round(units[before] @ units[a], _DIGITS)
        for i in np.flatnonzero(alive[:b] & ((partner[:b] == a) | (partner[:b] == b))):
            look(i)
        for i, c in zip(before[(close > best[before]) | (close == best[before]) & (a > partner[before])], close[(close > best[before]) | (close == best[before]) & (a > partner[before])], strict=True):
            best[i], partner[i] = c, a
        look(a)
    group = [0] * n
    for g, i in enumerate(np.flatnonzero(alive)):
        for member in members[i]:
            group[member] = g
    return group


def cluster_speakers(centroids: DataFrame, key: str = "meeting_id", *, threshold: float = MERGE_THRESHOLD) -> DataFrame:
    """Rows (key, speaker_num, centroid, weight) with the ``group`` their voice is merged in; one meeting is one group."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("speaker_num", kind="stable")
        return rows[[key, "speaker_num"]].assign(group=agglomerate(rows["centroid"].tolist(), rows["weight"].tolist(), threshold))

    kind = dict(centroids.dtypes)
    return centroids.groupBy(key).applyInPandas(fold, f"{key} {kind[key]}, speaker_num {kind['speaker_num']}, group int")


def renumber_by_talk(turns: DataFrame, key: str = "meeting_id", label: str = "group") -> DataFrame:
    """Turns with ``speaker_num`` set to the rank of their label by total length; the first seen wins ties."""
    total = turns.groupBy(key, label).agg(F.sum(F.col("end") - F.col("start")).alias("_secs"), F.min("turn_idx").alias("_first"))
    rank = total.withColumn("speaker_num", (F.row_number().over(W.partitionBy(key).orderBy(F.col("_secs").desc(), "_first")) - 1).cast("int"))
    return turns.drop("speaker_num").join(rank.select(key, label, "speaker_num"), [key, label])


def merge_speakers(turns: DataFrame, key: str = "meeting_id", *, threshold: float = MERGE_THRESHOLD) -> DataFrame:
    """Over-split turns (key, turn_idx, start, end, speaker_num, embedding) with merged, renumbered speakers.

    A speaker without a turn long enough for a voiceprint gets, turn by turn, the group
    of the nearest turn that has one; a meeting without any keeps its speakers.
    """
    weight = turns.groupBy(key, "speaker_num").agg(F.sum(F.col("end") - F.col("start")).alias("weight"))
    groups = cluster_speakers(speaker_centroids(turns, key).join(weight, [key, "speaker_num"]), key, threshold=threshold)
    placed = turns.drop("embedding").withColumn("mid", (F.col("start") + F.col("end")) / 2).join(groups, [key, "speaker_num"], "left")
    known = placed.filter(F.col("group").isNotNull())
    orphans = nearest(placed.filter(F.col("group").isNull()).drop("group"), known.select(key, "mid", "turn_idx", "group"), key, "mid", "turn_idx", "group")
    labelled = known.unionByName(orphans).withColumn("group", F.coalesce(F.col("group").cast("long"), -1 - F.col("speaker_num").cast("long")))
    return renumber_by_talk(labelled, key).select(key, "turn_idx", "start", "end", "speaker_num")


#: Speakers that are decided among themselves at a time: their distances are one matrix.
ARRIVALS = 2048


def _leaders(units: np.ndarray, max_distance: float) -> list[int]:
    """Places of the rows that no earlier leader is close to."""
    close, out = np.round(1 - units @ units.T, _DIGITS) < max_distance, []
    covered = np.zeros(len(units), dtype=bool)
    for i in range(len(units)):
        if not covered[i]:
            out.append(i)
            covered |= close[i]
    return out


def new_people(missed: DataFrame, *, max_distance: float = MAX_DISTANCE, at_once: int = ARRIVALS) -> DataFrame:
    """Those of ``missed`` (rank, v) that become people: every one that no earlier one of them is close to.

    The first ``at_once`` in order are decided among themselves; all that are
    close to one of the people so found are decided too, in one pass over the
    rest. So a voice that many speakers share costs one round, and each round decides ``at_once`` rows or more.
    """
    left, found = written(missed), []
    while True:
        head = left.orderBy("rank").limit(at_once).toArrow()
        if not head.num_rows:
            break
        units = _units(np.array(head.column("v").to_pylist(), dtype=np.float64))
        new = _leaders(units, max_distance)
        ranks = head.column("rank").to_numpy()
        found.append(written(left.sparkSession.createDataFrame([(int(ranks[i]), head.column("v")[i].as_py()) for i in new], left.schema)))
        if head.num_rows < at_once:
            break
        sent = left.sparkSession.sparkContext.broadcast((int(ranks[-1]), units[new]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            last, leaders = sent.value
            for batch in batches:
                if batch.num_rows:
                    distance = np.round(1 - _units(np.array(batch.column(1).to_pylist(), dtype=np.float64)) @ leaders.T, _DIGITS)
                    yield batch.filter(pa.array((batch.column(0).to_numpy() > last) & ~(distance < max_distance).any(axis=1)))

        left = written(left.mapInArrow(run, left.schema))
        sent.unpersist()
    out = missed.limit(0)
    for part in found:
        out = out.unionByName(part)
    return out


def resolve_people(speakers: DataFrame, people: DataFrame, *, max_distance: float = MAX_DISTANCE, vector: str = "voice_embedding", at_once: int = ARRIVALS) -> tuple[DataFrame, DataFrame]:
    """(speaker rows with ``person_id``, people to add) for speakers (meeting_id, speaker_num, centroid).

    The result is that of taking the speakers in order, each with the nearest
    person there is, or adding one if none is close: a speaker added for one is seen by those after it.
    Whoever is close to a stored person never becomes one. Of the others, those become people that no
    earlier new person is close to. Then each speaker meets all stored people, and all new ones before it.
    """
    asked = dense_number(speakers, ["meeting_id", "speaker_num"], into="rank")
    stored = written(nearest_person(asked, people, query_id="rank", vector="centroid", person_vector=vector, max_distance=max_distance))
    missed = asked.join(stored.select(F.col("query_id").alias("rank")), "rank", "left_anti").select("rank", F.col("centroid").alias("v"))
    leaders = dense_number(new_people(missed, max_distance=max_distance, at_once=at_once), ["rank"], after=greatest(people))
    seen = nearest_person(asked, leaders, query_id="rank", vector="centroid", person_vector="v", max_distance=max_distance, earlier=True)
    own = leaders.select(F.col("rank").alias("query_id"), F.col("id").alias("person_id"), F.lit(-1.0).alias("distance"))
    nearest_one = stored.unionByName(seen).unionByName(own).groupBy("query_id").agg(F.min_by("person_id", F.struct("distance", "person_id")).alias("person_id"))
    resolved = asked.join(nearest_one.withColumnRenamed("query_id", "rank"), "rank").select("meeting_id", "speaker_num", "person_id")
    return resolved, leaders.select(F.col("id").cast("int").alias("id"), F.lit(None).cast("string").alias("name"), F.col("v").alias(vector))


def identify_segments(segments: DataFrame, resolved: DataFrame) -> DataFrame:
    """Segments with ``person_id`` by meeting and speaker; null for the unattributed."""
    return segments.join(resolved, ["meeting_id", "speaker_num"], "left")
