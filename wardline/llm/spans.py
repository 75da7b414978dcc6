"""Long exact spans shared between records: compact windows.

The tokens of a text are its runs of ``GRAM`` characters. A compact window
(l, c, r) is a node of the Cartesian tree over their hashes: token c is the
leftmost minimum of exactly the subsequences that start in [l, c] and end in
[c, r]. Only nodes wide enough to hold SPAN characters are built. Two texts that
share SPAN characters verbatim share the tokens, so they share the minimum, and
each has a compact window with this signature that holds the span: one hash
function finds every such pair. Windows are joined by signature, aligned at c, and the
common text around c is compared, which verifies the span exactly.

Records with the same text are one class up to the last step. A signature of many
records (a footer somewhat shorter than SPAN, or a passage that really is
everywhere) isn't paired up: each record's spans of SPAN characters in that window are
grouped by two 64-bit hashes, so that only records that share a span meet; groups
with the same records are one, and groups inside a larger one are left out. Pairs
of a group are made only where pairs are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm import windows as K
from wardline.llm.leakage import batches_of
from wardline.scratch import materialize
from wardline.shipping import ship

SPAN, GRAM = 300, 150
WIDTH = SPAN - GRAM + 1
#: A signature of so many representatives at most, with four times as many windows, is paired up directly.
FEW = 64
#: Pairs that are compared, and windows that are laid out, at a time: some 20 MB.
PAIRS, MEMBERS = 4096, 8192
#: Representatives of a large group that one task pairs with all of the group.
GROUP_ROWS = 1000
#: Groups of more than FEW records that one record is in, up to which its partners are counted by inclusion and exclusion.
MOST_SETS = 8
_MATCH = "a long, b long, start_a int, start_b int, chars int"


def _compact(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per text of at least SPAN characters: its number, and hash, c, l, r of its compact windows."""
    data, offsets = K.code_points(texts)
    grams = K.gram_hashes(data, GRAM)
    for i in range(len(texts)):
        start, stop = int(offsets[i]), int(offsets[i + 1])
        if stop - start < SPAN:
            continue
        own = grams[start : stop - GRAM + 1]
        if len(own) <= K.MAX_CHUNK:
            places = K.window_minima(own, WIDTH)
        else:
            places = np.unique(np.concatenate([a + K.window_minima(own[a:b], WIDTH) for a, b in K.pieces(len(own), WIDTH)]))
        left, right = K.cartesian_bounds(own[places], places, len(own))
        yield i, own[places], places, left, right


def _text_key(text: str) -> tuple[int, int]:
    digest = blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, t1, doc, t2) once per signature and document; t2 stands in one row of each document."""
    for ids, texts in batches_of((b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for b in batches):
        hs, docs, t1s, t2s = [], [], [], []
        for i, h, *_ in _compact(texts):
            h = np.unique(h)
            t1, t2 = _text_key(texts[i])
            hs.append(h.view(np.int64))
            docs.append(np.full(len(h), ids[i], dtype=np.int64))
            t1s.append(np.full(len(h), t1, dtype=np.int64))
            t2s.extend([t2, *[None] * (len(h) - 1)])
        if hs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.concatenate(t1s)), pa.array(np.concatenate(docs)), pa.array(t2s, pa.int64())], ["h", "t1", "doc", "t2"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compact windows with a shared signature, with the text that their spans may cover."""

    def rows() -> Iterator[tuple[list, list]]:
        for b in batches:
            yield list(zip(*(b.column(k).to_pylist() for k in ("doc", "hs", "crowds")))), b.column("text").to_pylist()

    for keys, texts in batches_of(rows()):
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for i, h, c, left, right in _compact(texts):
            doc, hs, crowds = keys[i]
            crowded = dict(zip(hs, crowds))
            signed = h.view(np.int64)
            for k in np.flatnonzero(np.isin(signed, np.asarray(hs, dtype=np.int64))).tolist():
                at = int(c[k])
                start = max(int(left[k]), at - WIDTH + 1)
                stop = min(int(right[k]), at + WIDTH - 1) + GRAM
                for values, v in zip(out, (int(signed[k]), crowded[int(signed[k])], doc, start, at - start, texts[i][start:stop])):
                    values.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["h", "crowded", "doc", "start", "back", "piece"])


def _rows_of(texts: list[str], fill: int) -> np.ndarray:
    """Texts as rows of code points, filled up on the right with a value that is none."""
    data, offsets = K.code_points(texts)
    lengths = np.diff(offsets)
    out = np.full((len(texts), int(lengths.max(initial=0)) + 1), fill, dtype=np.int32)
    row = np.repeat(np.arange(len(texts)), lengths)
    out[row, np.arange(len(data)) - offsets[row]] = data
    return out


def _pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the windows of one signature with each other, around the shared minimum."""
    for batch in batches:
        groups = batch.column("members")
        ends = groups.offsets.to_numpy().astype(np.int64)
        found = [np.empty((0, 5), dtype=np.int64)]
        at = 0
        while at < len(groups):  # as many groups at a time as have MEMBERS windows
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + MEMBERS, side="right")) - 1)
            found.extend(_matches_of(groups.values.slice(ends[at], ends[to] - ends[at]), np.diff(ends[at : to + 1])))
            at = to
        out = np.concatenate(found)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1]), *(pa.array(out[:, k].astype(np.int32)) for k in (2, 3, 4))], ["a", "b", "start_a", "start_b", "chars"])


def _matches_of(members: pa.StructArray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Matches within groups of windows that lie one after the other, PAIRS pairs at a time."""
    doc, start, back = (members.field(k).to_numpy().astype(np.int64) for k in ("doc", "start", "back"))
    pieces = members.field("piece").to_pylist()
    heads = _rows_of([t[:b][::-1] for t, b in zip(pieces, back.tolist())], -1)
    tails = _rows_of([t[b:] for t, b in zip(pieces, back.tolist())], -1)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # member x of a group meets the members after it
    partners = np.repeat(sizes, sizes) - 1 - place
    ends = np.cumsum(partners)
    total = int(ends[-1]) if len(ends) else 0
    for low in range(0, total, PAIRS):
        k = np.arange(low, min(low + PAIRS, total))
        x = np.searchsorted(ends, k, side="right")
        y = x + 1 + (k - (ends[x] - partners[x]))
        apart = doc[x] != doc[y]
        x, y = x[apart], y[apart]
        x, y = np.where(doc[x] < doc[y], x, y), np.where(doc[x] < doc[y], y, x)
        after, before = _common(tails, x, y), _common(heads, x, y)
        good = (after >= GRAM) & (before + after >= SPAN)
        x, y, before, after = x[good], y[good], before[good], after[good]
        yield np.stack([doc[x], doc[y], start[x] + back[x] - before, start[y] + back[y] - before, before + after], axis=1)


def _common(rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many leading values the rows x and y have in common, without the fill."""
    a, b = rows[x], rows[y]
    return np.argmin((a == b) & (a >= 0), axis=1)


def _spans_of_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of every span of SPAN characters in a window that holds its minimum."""
    for batch in batches:
        hs, k1s, k2s, docs, starts = [], [], [], [], []
        for h, doc, start, piece in zip(*(batch.column(k).to_pylist() for k in ("h", "doc", "start", "piece"))):
            points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            if len(points) < SPAN:
                continue
            k1s.append(K.gram_hashes(points, SPAN))
            k2s.append(K.gram_hashes(points.astype(np.uint64) + np.uint64(1 << 40), SPAN))
            hs.append(np.full(len(k1s[-1]), h, dtype=np.int64))
            docs.append(np.full(len(k1s[-1]), doc, dtype=np.int64))
            starts.append(np.arange(start, start + len(k1s[-1]), dtype=np.int32))
        if k1s:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, [k.view(np.int64) for k in k1s], [k.view(np.int64) for k in k2s], docs, starts)], ["h", "k1", "k2", "doc", "start"])


class SharedSpans:
    """What the parts of one search give: classes of equal texts and matches between their representatives."""

    def __init__(self, docs: DataFrame, few: int = FEW) -> None:
        ship(docs.sparkSession)
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") >= SPAN))
        signatures, _ = materialize(texts.mapInArrow(_signatures, "h long, t1 long, doc long, t2 long"), "signatures")
        heads = signatures.where("t2 is not null").select("t1", "t2", "doc").distinct()
        classes = heads.groupBy("t1", "t2").agg(F.min("doc").alias("rep"), F.count("*").alias("size")).where("size > 1")
        #: ``doc``, ``rep``, ``size`` of documents whose text (of SPAN characters or more) is in several documents.
        self.copies = heads.join(classes, ["t1", "t2"]).select("doc", "rep", "size")
        reps = signatures.groupBy("h", "t1").agg(F.min("doc").alias("doc"))
        shared = reps.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1").select("h", (F.col("_n") > few).alias("crowded"))
        wanted = reps.join(shared, "h").groupBy("doc").agg(F.collect_list("h").alias("hs"), F.collect_list("crowded").alias("crowds"))
        found = wanted.join(texts.withColumnRenamed("doc_id", "doc"), "doc").select("doc", "hs", "crowds", "text").mapInArrow(_windows, "h long, crowded boolean, doc long, start int, back int, piece string")
        windows, _ = materialize(found, "windows")
        # a signature may also come many times in a few texts; those are bounded by the texts
        of_few = windows.where("not crowded")
        again = of_few.groupBy("h").agg(F.count("*").alias("_n")).where(F.col("_n") > 4 * few).select("h")
        groups = of_few.join(again, "h", "left_anti").groupBy("h").agg(F.collect_list(F.struct("doc", "start", "back", "piece")).alias("members"))
        direct = groups.where("size(members) > 1").select("members").mapInArrow(_pair_up, _MATCH)
        #: Matches between representatives; ``a`` < ``b``, each with the start and the length of a shared run.
        self.direct, _ = materialize(direct, "matches")
        many = windows.where("crowded").unionByName(of_few.join(again, "h", "left_semi"))
        spans, _ = materialize(many.select("h", "doc", "start", "piece").mapInArrow(_spans_of_windows, "h long, k1 long, k2 long, doc long, start int"), "spans")
        per_key = spans.groupBy("k1", "k2").agg(F.min("doc").alias("_a"), F.max("doc").alias("_b"), F.count("*").alias("_n"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("_s"), F.bit_xor(F.xxhash64(F.lit(3), "doc")).alias("_x"), F.min("h").alias("h")).where("_a < _b")
        per_key, _ = materialize(per_key, "keys")
        # keys with the same records are one group, named by its least key
        named = per_key.groupBy("_a", "_b", "_n", "_s", "_x").agg(F.min(F.struct("k1", "k2")).alias("k")).select("k.k1", "k.k2", F.lit(True).alias("names"))
        told = per_key.select("k1", "k2", "_n", F.col("h").alias("_h")).join(named, ["k1", "k2"], "left")
        shared, _ = materialize(spans.join(told, ["k1", "k2"]).select("k1", "k2", "doc", "start", "_n", "_h", "names"), "shared-spans")
        #: Spans of crowded windows that stand in several representatives.
        self.crowded = shared.select("doc", "start")
        members = shared.where("names").groupBy("k1", "k2", "doc").agg(F.max("_n").alias("_n"), F.max("_h").alias("_h"))
        # a group whose records all have the same larger group of its signature lies in that group and tells nothing new
        largest = members.groupBy("_h", "doc").agg(F.max(F.struct("_n", "k1", "k2")).alias("_top"))
        over = members.join(largest, ["_h", "doc"]).groupBy("k1", "k2").agg(F.min("_top").alias("_low"), F.max("_top").alias("_high"), F.count("*").alias("size"))
        own = (F.col("_low.k1") == F.col("k1")) & (F.col("_low.k2") == F.col("k2"))
        kept = over.where((F.col("_low") != F.col("_high")) | own).select("k1", "k2", "size")
        #: Groups of representatives that share a span: ``g``, ``doc``, ``size`` (representatives of the group).
        self.groups, _ = materialize(members.join(kept, ["k1", "k2"]).select(F.struct("k1", "k2").alias("g"), "doc", "size"), "groups")
        self.few = few

    def _within(self, groups: DataFrame) -> DataFrame:
        """Pairs of representatives of one group, each perhaps several times; a large group is dealt to several tasks, each of which meets all of it."""
        tasks = F.ceil(F.col("size") / F.lit(GROUP_ROWS)).cast("int")
        own = groups.select("g", F.col("doc").alias("a"), F.pmod(F.xxhash64("doc"), tasks).cast("int").alias("_task"))
        other = groups.select("g", F.col("doc").alias("b"), F.explode(F.sequence(F.lit(0), tasks - 1)).alias("_task"))
        return own.join(other, ["g", "_task"]).where("a < b").select("a", "b")

    def all_pairs(self) -> DataFrame:
        """``doc_id_a`` < ``doc_id_b``: all pairs of documents, copies too."""
        pairs = self.direct.select("a", "b").unionByName(self._within(self.groups)).distinct()
        by_rep = self.copies.select(F.col("rep"), F.col("doc"))
        wide = pairs.join(by_rep.select(F.col("rep").alias("a"), F.col("doc").alias("_a")), "a", "left").join(by_rep.select(F.col("rep").alias("b"), F.col("doc").alias("_b")), "b", "left")
        between = wide.select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
        within = by_rep.select("rep", F.col("doc").alias("x")).join(by_rep.select("rep", F.col("doc").alias("y")), "rep").where("x < y").select("x", "y")
        return between.unionByName(within).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))

    def _links(self) -> DataFrame:
        """``doc``, ``others``: the documents, copies counted, of other representatives that share a span with a representative.

        Groups of FEW representatives or fewer, and the direct matches, are pairs, at
        most FEW for each row. Representatives in the same larger groups are of one
        kind; the partners that a kind has through these groups are counted per kind, by inclusion and exclusion over
        what kinds lie in each set of groups, or, for kinds in more than MOST_SETS
        groups, kind by kind. A pair within a larger group isn't counted again.
        """
        sizes = self.copies.where("doc = rep").select("rep", "size")
        large = self.groups.where(F.col("size") > self.few)
        listed = large.groupBy("doc").agg(F.array_sort(F.collect_set("g")).alias("sets"))
        of_kind, _ = materialize(listed.join(sizes, listed["doc"] == sizes["rep"], "left").select("doc", "sets", F.coalesce("size", F.lit(1)).alias("_w")), "kinds")
        kinds, _ = materialize(of_kind.groupBy("sets").agg(F.sum("_w").alias("_w")), "kind-sizes")

        few_sets = F.size("sets") <= MOST_SETS
        masks = F.sequence(F.lit(1), F.pow(F.lit(2.0), F.size("sets")).cast("int") - 1)
        every = F.transform(masks, lambda m: F.filter("sets", lambda g, i: F.pmod(F.floor(m / F.pow(F.lit(2.0), i)), F.lit(2)) == 1))
        asked = kinds.where(few_sets).select("sets", F.explode(every).alias("part"))
        # kinds in many groups take part in the counts of the others' sets, but not by all their own sets
        inside = asked.select("part").distinct().withColumn("g", F.col("part")[0]).join(kinds.where(~few_sets).select(F.explode("sets").alias("g"), "sets", "_w"), "g")
        inside = inside.where(F.size(F.array_except("part", "sets")) == 0).select("part", "_w")
        counted = kinds.where(few_sets).select(F.explode(every).alias("part"), "_w").unionByName(inside).groupBy("part").agg(F.sum("_w").alias("_in"))
        signed = F.when(F.size("part") % 2 == 1, F.col("_in")).otherwise(-F.col("_in"))
        by_few = asked.join(counted, "part").groupBy("sets").agg(F.sum(signed).alias("_reach"))
        each = kinds.select(F.explode("sets").alias("g"), "sets", "_w")
        met = each.where(~few_sets).select("g", F.col("sets").alias("own")).join(each, "g").groupBy("own", "sets").agg(F.max("_w").alias("_w"))
        by_many = met.groupBy("own").agg(F.sum("_w").alias("_reach")).withColumnRenamed("own", "sets")
        through_large = of_kind.join(by_few.unionByName(by_many), "sets").select("doc", (F.col("_reach") - F.col("_w")).alias("others"))

        pairs = self.direct.select("a", "b").unionByName(self._within(self.groups.where(F.col("size") <= self.few))).distinct()
        sets = of_kind.select("doc", "sets")
        known = pairs.join(sets.select(F.col("doc").alias("a"), F.col("sets").alias("_sa")), "a", "left").join(sets.select(F.col("doc").alias("b"), F.col("sets").alias("_sb")), "b", "left")
        new = known.where(~F.coalesce(F.arrays_overlap("_sa", "_sb"), F.lit(False))).select("a", "b")
        both = new.select(F.col("a").alias("doc"), F.col("b").alias("rep")).unionByName(new.select(F.col("b").alias("doc"), F.col("a").alias("rep")))
        through_few = both.join(sizes, "rep", "left").select("doc", F.coalesce("size", F.lit(1)).alias("others"))
        return through_large.unionByName(through_few).groupBy("doc").agg(F.sum("others").alias("others"))

    def per_document(self, docs: DataFrame) -> DataFrame:
        """``doc_id``, ``class_id``, ``links``, ``shared_chars``, ``n_chars`` of every document with an id.

        ``class_id`` is the smallest id with the same text (of SPAN characters or
        more); ``links`` counts the documents that share a span with this one, copies
        included; ``shared_chars`` counts the characters that lie in any shared span.
        No pairs of documents are made for a span of many texts; see ``_links``.
        """
        runs = self.direct.select(F.col("a").alias("doc"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("chars")).alias("e"))
        runs = runs.unionByName(self.direct.select(F.col("b").alias("doc"), F.col("start_b").alias("s"), (F.col("start_b") + F.col("chars")).alias("e")))
        runs = runs.unionByName(self.crowded.select("doc", F.col("start").alias("s"), (F.col("start") + SPAN).alias("e")))
        longest = runs.groupBy("doc", "s").agg(F.max("e").alias("e"))
        so_far = F.max("e").over(Window.partitionBy("doc").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
        covered = longest.withColumn("_until", F.coalesce(so_far, F.lit(0))).groupBy("doc").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "_until"))).cast("long").alias("covered"))
        known = covered.join(self._links(), "doc", "full").withColumnRenamed("doc", "rep")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")).where("doc is not null")
        full = rows.join(self.copies, "doc", "left").withColumn("rep", F.coalesce("rep", "doc")).join(known, "rep", "left")
        return full.select(
            F.col("doc").alias("doc_id"),
            F.col("rep").alias("class_id"),
            (F.coalesce("others", F.lit(0)) + F.coalesce("size", F.lit(1)) - 1).alias("links"),
            F.when(F.col("size").isNotNull(), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).alias("shared_chars"),
            "n_chars",
        )


def shared_spans(docs: DataFrame, few: int = FEW) -> SharedSpans:
    """Search documents (``doc_id``, unique, and ``text``) for spans of at least SPAN characters in several of them.

    Null texts and those under SPAN characters share nothing; repeats within one
    document don't count; rows with a null id are left out; other columns are not
    read; empty tables give no pairs. ``few`` only chooses the way, not the result.
    """
    return SharedSpans(docs, few)
