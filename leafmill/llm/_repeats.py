"""Skeleton of the two repeat removers (words and bytes).

A text is a sequence of units.  Every window of ``window`` units has an *anchor*: the leftmost
smallest hash among its grams of ``gram`` units (winnowing).  Consecutive windows with one anchor
form a *run*; equal windows have equal anchors at equal offsets, so a repeat can only be found
between runs of one anchor.  Equal runs form a *class*: its earliest member stands for all, with the
others counted and listed beside it.

    documents -> runs -> [anchor] classes of repeated anchors -> [id] earliest members cut from the text
              -> [anchor] verdicts on their windows -> [id] windows removed -> [id] spans per document

Brackets are shuffles.  Texts cross the network once (both joins read the same exchange); unique
anchors, the bulk of a corpus, leave after the first shuffle.  Which windows repeat is decided only by
the operator's method, over the classes' texts: in shards of bounded size, which end between anchors.
The first member's windows repeat where another class has them earlier (``own``); those of all others
where the method meets them at all (``again``).  Equal runs of one Arrow batch send one row to the
anchor; the others follow the verdict on that one, so a passage that a third of all documents share
costs a few rows per batch.  Runs that a document repeats follow its own first one, and a stretch that
repeats itself for long is listed once, with its period.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import _induced as I
from . import _text as X

# place: first window << 32 | whether runs of the batch follow this one << 31 | number of windows; extra: followers
RUNS = "anchor long, ctx long, id long, place long, tag long, extra binary"
CLASSES = "kind int, anchor long, id long, tag long, start int, n int, many boolean, followed boolean, extra binary"
CUTS = CLASSES + ", body binary"
FOUND = "kind int, id long, tag long, start int, n int, extra binary"
SPANS = "id long, tag long, start int, n int"

#: Kinds of CLASSES rows: earliest member of a class (extra: others), more of its members, lists of followers,
#: and the earliest member of an anchor's only class; of FOUND rows: windows that are removed, windows whose followers are removed, both, followers.
LEAD, MORE, FOLLOWS, LONE = 0, 1, 2, 3
OWN, AGAIN, BOTH, FOLLOWER = 0, 1, 2, 3
MEMBER = np.dtype([("id", "<i8"), ("tag", "<i8"), ("start", "<i4"), ("followed", "u1")])
#: The same with the windows [at, at + n) of the class's text that a member shares.
PART = np.dtype([*((k, MEMBER[k]) for k in MEMBER.names), ("at", "<i4"), ("n", "<i4")])
#: Windows [start, start + n) of a follower equal those of the document that leads from ``at`` on, which repeat
#: after ``period``; rows of the leading document list its followers.
FOLLOW = np.dtype([("id", "<i8"), ("tag", "<i8"), ("start", "<i4"), ("at", "<i4"), ("n", "<i4"), ("period", "<i4")])
#: Documents of an Arrow batch with equal runs of which one leads.
FOLLOWERS = 64
#: Members that one row lists, and bytes of text after which a shard ends at the next anchor.
MEMBERS, SHARD_BYTES = 4_096, 4_000_000

#: Stated wherever rows are joined by key, so that inner and outer joins read the same exchange.
USABLE = "id is not null and tag is not null"


@dataclass(frozen=True)
class Unit:
    """What a sequence consists of.  ``values(data, offsets)`` gives one hash per unit, the units'
    byte bounds and the first unit of every text; ``within`` lets a document repeat itself."""

    window: int
    gram: int
    values: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    within: bool
    followers: int = FOLLOWERS
    members: int = MEMBERS
    #: Neighbouring classes that are alone at their anchors become one text.
    chains: bool = False


def byte_values(data: np.ndarray, offsets: np.ndarray):
    at = np.arange(len(data) + 1)
    return X._TABLE[0][data], at[:-1], at[1:], offsets


def word_values(data: np.ndarray, offsets: np.ndarray):
    starts, ends, first = X.word_bounds(data, offsets, X.space_class())
    return X.bytes_hash(data, starts, ends), starts, ends, first


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> tuple[DataFrame, DataFrame, bool]:
    """(id, tag, text) of every row, the rows to search (one per (id, tag), no null ids), and whether ids repeat.

    ``tag`` is 0 unless an id occurs more than once; then it is a hash of the text, so that repeated
    rows count as one document and equal ids with different texts as two.  With ``carry`` the rows bring
    ``rest``: whether the text is null, and all other columns.
    """
    X.small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    rest = [F.struct(F.col(f"`{text_col}`").isNull().alias("null"), others.alias("row")).alias("rest")] if carry else []
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), *rest)
    repeated = plain.filter("id is not null").groupBy("id").count().filter("count > 1").limit(1).count() > 0
    rows = plain.select("id", (F.xxhash64("text") if repeated else F.col("id") - F.col("id")).alias("tag"), "text", *["rest"] * carry)
    search = rows.filter(USABLE).select("id", "tag", "text")
    return rows, search.dropDuplicates(["id", "tag"]) if repeated else search, repeated


def tables(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows with deflated texts, the plain rows to search, and the rows to cut from.

    Where no id repeats the first and the last are one plan, so that the joins read one exchange of the texts.
    """
    rows, search, repeated = keyed(docs, id_col, text_col, carry)
    small = squeezed(rows)
    return small, search, squeezed(search) if repeated else small.filter(USABLE)


def squeezed(rows: DataFrame) -> DataFrame:
    """``rows`` with deflated texts, for their way through the shuffle."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield batch.set_column(2, "text", pa.array([press.compress(t.as_buffer() or b"") for t in batch.column(2).cast(pa.binary())], pa.binary()))

    schema = StructType([StructField("text", BinaryType()) if f.name == "text" else f for f in rows.schema.fields])
    return rows.mapInArrow(X.tidy(squeeze), schema)


def unsqueezed(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As :func:`_text.chunks`, of deflated texts."""
    raw = zstandard.ZstdDecompressor()
    lo, texts, held = 0, [], 0
    for k, t in enumerate(column):
        texts.append(raw.decompress(t.as_buffer()))
        held += len(texts[-1])
        if held >= X.CHUNK_BYTES or k + 1 == len(column):
            yield lo, k + 1, np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(x) for x in texts]))
            lo, texts, held = k + 1, [], 0


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals per document number; results are sorted."""
    if len(doc) == 0:
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order].astype(np.int64), start[order].astype(np.int64), end[order].astype(np.int64)
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(doc * wide + end)
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] * wide + start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], reach[last] - doc[at] * wide


def _table(schema: str, *columns) -> pa.RecordBatch:
    """A batch of a schema given as text; no column or a None stands for nulls."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*((k, kinds[t]) for k, t in (c.split(" ") for c in schema.split(", "))), strict=True)
    n = len(next(c for c in columns if c is not None))
    arrays = [pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip((*columns, *[None] * (len(types) - len(columns))), types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


def _spread(ids: np.ndarray) -> np.ndarray:
    return X.mix(ids.astype(np.uint64)).view(np.int64)


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def runs_of(values: np.ndarray, first: np.ndarray, window: int, gram: int):
    """Runs of all texts: text number, first window start (from the text's start), windows, anchor and context hash."""
    count = np.maximum(np.diff(first) - window + 1, 0)
    s = X.gather_ranges(first[:-1], count)
    if len(s) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    at = np.arange(len(values) - gram + 1)
    grams = X.ranges_hash(values, at, at + gram)
    a = X.window_minimum(grams, window - gram + 1)[s]
    head = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    n = np.diff(np.append(head, len(s)))
    s0, anchor = s[head], a[head]
    ctx = X.ranges_hash(values, s0, s0 + n + window - 1, 1) + X.mix((anchor - s0).astype(np.uint64))
    doc = np.searchsorted(first, s0, "right") - 1
    return doc, s0 - first[doc], n, X.mix(grams[anchor]), ctx


def _emit_runs(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            parts = []
            for lo, _, data, offsets in X.chunks(batch.column(2)):
                values, _, _, first = unit.values(data, offsets)
                doc, start, n, anchor, ctx = runs_of(values, first, unit.window, unit.gram)
                parts.append((doc + lo, start, n, anchor, ctx))
            if not parts:
                continue
            doc, start, n, anchor, ctx = (np.concatenate(x) for x in zip(*parts, strict=True))
            place = np.empty(len(ids), np.int64)
            place[np.lexsort((tags, ids))] = np.arange(len(ids))
            order = np.argsort((place[doc] << 32) | start)
            order = order[np.argsort((X.mix(anchor) + ctx)[order], kind="stable")]
            doc, start, n, anchor, ctx = (x[order] for x in (doc, start, n, anchor, ctx))
            head = np.append(True, (anchor[1:] != anchor[:-1]) | (ctx[1:] != ctx[:-1]))[: len(doc)]
            # the first run of every so many documents of a class leads the others
            class_ = np.cumsum(head) - 1
            turn = np.cumsum(head | np.append(True, doc[1:] != doc[:-1])[: len(doc)])
            turn -= turn[np.flatnonzero(head)][class_]
            leads = np.append(True, (class_[1:] != class_[:-1]) | (turn[1:] // unit.followers != turn[:-1] // unit.followers))[: len(doc)]
            lead = np.flatnonzero(leads)[np.cumsum(leads) - 1]
            follows = ~leads
            d, s, m, l_doc, l_at, period = _chains(doc[follows], start[follows], n[follows], doc[lead[follows]], start[lead[follows]])
            if len(d):
                extra = np.empty(len(d), FOLLOW)
                extra["id"], extra["tag"], extra["start"], extra["at"], extra["n"], extra["period"] = ids[d], tags[d], s, l_at, m, period
                by_lead = np.argsort(l_doc, kind="stable")
                turn = np.arange(len(d))
                new = np.append(True, l_doc[by_lead][1:] != l_doc[by_lead][:-1])
                new |= (turn - np.maximum.accumulate(np.where(new, turn, 0))) % unit.members == 0
                at = np.flatnonzero(new)
                who, none = l_doc[by_lead][at], np.zeros(len(at), np.int64)
                lists = X.binary_column(np.frombuffer(extra[by_lead].tobytes(), np.uint8), FOLLOW.itemsize * np.append(at[1:], len(d)))
                yield _table(RUNS, _spread(ids[who]), none, ids[who], none, tags[who], lists)
            followed = np.zeros(len(doc), np.int64)
            followed[lead[follows & (unit.within | (ids[doc] != ids[doc[lead]]))]] = 1
            k = np.flatnonzero(leads)
            k = k[np.argsort(doc[k] << 32 | start[k])]  # a document's runs stand together and compress better
            yield _table(RUNS, anchor[k].view(np.int64), ctx[k].view(np.int64), ids[doc[k]], start[k] << 32 | followed[k] << 31 | n[k], tags[doc[k]])

    return emit


def _chains(doc: np.ndarray, start: np.ndarray, n: np.ndarray, lead: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Consecutive runs that follow consecutive runs of one other text, joined; then those of them that follow
    the same windows again and again, with the period."""
    order = np.lexsort((start, doc))
    doc, start, n, lead, at = (x[order] for x in (doc, start, n, lead, at))
    period = n
    for again in (False, True):
        goes_on = (doc[1:] == doc[:-1]) & (lead[1:] == lead[:-1]) & (start[1:] == start[:-1] + n[:-1])
        goes_on &= (at[1:] == at[:-1]) & (n[1:] == n[:-1]) if again else at[1:] == at[:-1] + n[:-1]
        head = np.flatnonzero(np.append(True, ~goes_on)[: len(doc)])
        total = np.append(0, np.cumsum(n))
        period = n[head]
        n = total[np.append(head[1:], len(doc))] - total[head] if len(doc) else n
        doc, start, lead, at = (x[head] for x in (doc, start, lead, at))
    return doc, start, n, lead, at, period


def _classes(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of runs sorted by (anchor, ctx, id, tag, place): classes of anchors that occur more than once.

    The last class waits for the next batch, as the first row of it.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: tuple | None = None  # anchor, ctx, id, tag, place, many, several contexts, listed members
        for batch in batches:
            plain = batch.column(5).is_null().to_numpy(zero_copy_only=False)
            if not plain.all():
                rest = batch.filter(pa.array(~plain))
                anchor, ids, tags, place = _columns(rest, "anchor", "id", "tag", "place")
                no = np.zeros(len(ids), bool)
                yield _table(CLASSES, np.full(len(ids), FOLLOWS), anchor, ids, tags, place, place, no, no, rest.column(5))
                batch = batch.filter(pa.array(plain))
            anchor, ctx, ids, tags, place = _columns(batch, "anchor", "ctx", "id", "tag", "place")
            if len(anchor) == 0:
                continue
            if wait is not None:
                anchor, ctx, ids, tags, place = (np.append(w, x) for w, x in zip(wait[:5], (anchor, ctx, ids, tags, place), strict=True))
            new_a = np.append(True, anchor[1:] != anchor[:-1])
            new_c = new_a | np.append(True, ctx[1:] != ctx[:-1])
            heads = np.flatnonzero(new_c)
            which, group = np.cumsum(new_c) - 1, np.cumsum(new_a) - 1
            other = ~new_c & (unit.within | (ids != ids[heads[which]]))
            many = np.logical_or.reduceat(other | (place >> 31 & 1 > 0), heads)
            several = np.bincount(group[heads]) > 1
            listed = MEMBER_NONE
            if wait is not None:
                many[0] |= wait[5]
                several[0] |= wait[6]
                listed = wait[7]
            members = np.flatnonzero(~new_c)
            records = np.empty(len(members), MEMBER)
            records["id"], records["tag"], records["start"], records["followed"] = ids[members], tags[members], place[members] >> 32, place[members] >> 31 & 1
            records = np.concatenate([listed, records])
            of = np.concatenate([np.zeros(len(listed), np.int64), which[members]])
            bounds = np.searchsorted(of, np.arange(len(heads) + 1))
            done = many | several[group[heads]]
            done[-1] = False
            full = bounds[-1] - bounds[-2] >= unit.members  # of the class that waits: what it lists leaves
            kind = np.where(several[group[heads]], LEAD, LONE)[done]
            yield from _class_rows(heads[done], anchor, ids, tags, place, many[done], records, bounds[:-1][done], bounds[1:][done], kind, unit.members)
            h = heads[-1:]
            if full:
                several[-1] = True  # its first row must come, too
                yield from _class_rows(h, anchor, ids, tags, place, many[-1:], records, bounds[-2:-1], bounds[-1:], np.array([MORE]), unit.members)
            left = MEMBER_NONE if full else records[bounds[-2] :]
            wait = (anchor[h[0]], ctx[h[0]], ids[h[0]], tags[h[0]], place[h[0]], many[-1], several[-1], left)
        if wait is not None and (wait[5] or wait[6]):
            h = np.zeros(1, np.int64)
            yield from _class_rows(h, *(np.array([w]) for w in (wait[0], *wait[2:5])), np.array([wait[5]]), wait[7], h, np.array([len(wait[7])]), np.array([LEAD if wait[6] else LONE]), unit.members)

    return stream


MEMBER_NONE = np.zeros(0, MEMBER)


def _class_rows(heads, anchor, ids, tags, place, many, records, lo, hi, kind, most) -> Iterator[pa.RecordBatch]:
    """One row per class, and further ones for members beyond what a row lists."""
    size = MEMBER.itemsize
    raw = np.frombuffer(records.tobytes(), np.uint8)
    rows = np.maximum(1, -(-(hi - lo) // most))
    which = np.repeat(np.arange(len(heads)), rows)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(rows) - rows, rows)
    a = lo[which] + turn * most
    b = np.minimum(a + most, hi[which])
    extra = X.binary_column(raw[X.gather_ranges(a * size, (b - a) * size)], np.cumsum((b - a) * size))
    h = heads[which]
    first = np.where((kind == LONE) & (rows > 1), LEAD, kind)[which]
    if len(h):
        yield _table(CLASSES, np.where(turn == 0, first, MORE), anchor[h], ids[h], tags[h], place[h] >> 32, place[h] & 0x7FFFFFFF, many[which], (place[h] >> 31 & 1).astype(bool), extra)


def _parts(extra: pa.Array, n: np.ndarray, at: np.ndarray, of: np.ndarray) -> pa.Array:
    """Members of classes with the windows that they share, listed by text (``of``: ascending numbers)."""
    raw, ends = X.packed(extra)
    members = np.frombuffer(raw.tobytes(), MEMBER)
    owner = np.repeat(np.arange(len(n)), np.diff(ends) // MEMBER.itemsize)
    parts = np.empty(len(members), PART)
    for name in MEMBER.names:
        parts[name] = members[name]
    parts["at"], parts["n"] = at[owner], n[owner]
    count = np.bincount(of[owner], minlength=int(of[-1]) + 1)
    return X.binary_column(np.frombuffer(parts.tobytes(), np.uint8), np.cumsum(count) * PART.itemsize)


def _cut(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the text of every class, from its earliest member."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            lists = batch.column(3)
            rows = lists.flatten()
            doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
            kind, anchor, start, n, many, followed = (rows.field(k).to_numpy(zero_copy_only=False) for k in ("kind", "anchor", "start", "n", "many", "followed"))
            extra = rows.field("extra")

            def out(at: np.ndarray, size: np.ndarray, members: pa.Array, body: pa.Array | None) -> pa.RecordBatch:
                return _table(CUTS, np.where(kind[at] == LONE, LEAD, kind[at]), anchor[at], ids[doc[at]], tags[doc[at]], start[at], size, many[at], followed[at], members, body)

            if len(rest := np.flatnonzero(kind == FOLLOWS)):
                yield out(rest, n[rest], extra.take(pa.array(rest)), None)
            if len(rest := np.flatnonzero(kind == MORE)):
                yield out(rest, n[rest], _parts(extra.take(pa.array(rest)), n[rest], np.zeros(len(rest), np.int64), np.arange(len(rest))), None)
            todo = np.flatnonzero((kind == LEAD) | (kind == LONE))
            todo = todo[np.argsort(doc[todo] << 32 | start[todo])]
            for lo, hi, data, offsets in unsqueezed(batch.column(2)):
                mine = todo[(doc[todo] >= lo) & (doc[todo] < hi)]
                if len(mine) == 0:
                    continue
                _, starts, stops, first = unit.values(data, offsets)
                goes_on = (doc[mine][1:] == doc[mine][:-1]) & (start[mine][1:] == start[mine][:-1] + n[mine][:-1]) & (kind[mine][1:] == LONE) & (kind[mine][:-1] == LONE)
                heads = np.flatnonzero(np.append(True, ~(goes_on & unit.chains)))
                which = np.searchsorted(heads, np.arange(len(mine)), "right") - 1
                head = mine[heads]
                followed[head] = np.logical_or.reduceat(followed[mine], heads)
                s = first[doc[head] - lo] + start[head]
                last = mine[np.append(heads[1:], len(mine)) - 1]
                windows = start[last] + n[last] - start[head]
                a, b = starts[s], stops[s + windows + unit.window - 2]
                bounds = np.append(heads, len(mine))
                step = max(1, 2_000_000 // (4 * unit.window))
                for k in range(0, len(head), step):
                    part = slice(k, min(k + step, len(head)))
                    inside = mine[bounds[part.start] : bounds[part.stop]]
                    of = which[bounds[part.start] : bounds[part.stop]]
                    members = _parts(extra.take(pa.array(inside)), n[inside], start[inside] - start[head[of]], of - k)
                    size = b[part] - a[part]
                    yield out(head[part], windows[part], members, X.binary_column(data[X.gather_ranges(a[part], size)], np.cumsum(size)))

    return cut


KEY = np.dtype([("id", "<i8"), ("tag", "<i8"), ("start", "<i4"), ("n", "<i4"), ("base", "<i8"), ("group", "<i8"), ("many", "u1"), ("followed", "u1")])


class Shard:
    """Classes of whole anchors: their texts, each with a 0 byte behind it and all others one up, keys and members."""

    def __init__(self, room: int):
        self.text, self.keys = I.Shelf(np.uint8, room), I.Shelf(KEY, room)
        self.members = I.Shelf(np.dtype([("piece", "<i8"), ("m", PART)]), room)
        self.groups, self.anchor = 0, None

    def add(self, rows: pa.RecordBatch) -> None:
        kind, anchor, ids, tags, start, n, many, followed = _columns(rows, *(c.split(" ")[0] for c in CLASSES.split(", ")[:-1]))
        new = np.append(self.anchor is None or anchor[0] != self.anchor, anchor[1:] != anchor[:-1])
        group = self.groups - 1 + np.cumsum(new)
        self.groups, self.anchor = int(group[-1]) + 1, anchor[-1]
        lead = kind == LEAD
        at = np.flatnonzero(lead)
        piece = self.keys.size + np.cumsum(lead) - 1
        data, offsets = X.packed(rows.column("body").filter(pa.array(lead)))
        keys = np.empty(len(at), KEY)
        for name, x in (("id", ids), ("tag", tags), ("start", start), ("n", n), ("group", group), ("many", many), ("followed", followed)):
            keys[name] = x[at]
        keys["base"] = self.text.size + offsets[:-1] + np.arange(len(at))
        text = np.zeros(len(data) + len(at), np.uint8)
        text[np.arange(len(data)) + np.repeat(np.arange(len(at)), np.diff(offsets))] = data + np.uint8(1)
        self.text.append(text)
        self.keys.append(keys)
        raw, ends = X.packed(rows.column("extra"))
        count = np.diff(ends) // PART.itemsize
        members = np.empty(int(count.sum()), self.members.kind)
        members["piece"], members["m"] = np.repeat(piece, count), np.frombuffer(raw.tobytes(), PART)
        self.members.append(members)

    def close(self) -> None:
        for shelf in (self.text, self.keys, self.members):
            shelf.close()


def _intervals(row: np.ndarray, offset: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of hit windows: row, start and length; rows and offsets come in order."""
    row, offset = row[hit], offset[hit]
    head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1))[: len(row)])
    return row[head], offset[head], np.diff(np.append(head, len(row)))


def _verdicts(shard: Shard, base: np.ndarray, verdict: np.ndarray, within: bool) -> Iterator[pa.RecordBatch]:
    """FOUND rows of a shard.  ``verdict[base of a class + window]``: bit 0 own, bit 1 again."""
    keys, members = shard.keys.array(), shard.members.array()
    step = 4_000
    for part in I.blocks(len(keys), step):
        k = np.array(keys[part])
        n = k["n"].astype(np.int64)
        v = verdict[X.gather_ranges(base[part], n)]
        row = np.repeat(np.arange(len(k)), n)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        own, again = (_intervals(row, offset, v & bit > 0) for bit in (1, 2))
        yield _table(FOUND, np.full(len(own[0]), OWN), k["id"][own[0]], k["tag"][own[0]], k["start"][own[0]] + own[1], own[2])
        f = k["followed"][again[0]] > 0
        yield _table(FOUND, np.full(int(f.sum()), AGAIN), *(x[f] for x in (k["id"][again[0]], k["tag"][again[0]], k["start"][again[0]] + again[1], again[2])))
        lo, hi = np.searchsorted(members["piece"], [part.start, part.stop])
        for some in I.blocks(int(hi - lo), 50_000):
            m = np.array(members[lo + some.start : lo + some.stop])
            p, m = m["piece"] - part.start, m["m"]
            same = np.zeros(len(m), bool) if within else m["id"] == k["id"][p]
            for which, use, kinds in ((same, own, (OWN, OWN)), (~same, again, (OWN, BOTH)), (same & (m["followed"] > 0), again, (AGAIN, AGAIN))):
                bounds = np.searchsorted(use[0], np.arange(len(k) + 1))
                who = np.flatnonzero(which)
                count = bounds[p[who] + 1] - bounds[p[who]]
                i, who = X.gather_ranges(bounds[p[who]], count), np.repeat(who, count)
                a = np.maximum(use[1][i], m["at"][who])
                b = np.minimum(use[1][i] + use[2][i], m["at"][who].astype(np.int64) + m["n"][who])
                who, a, b = who[a < b], a[a < b], b[a < b]
                if len(who):
                    yield _table(FOUND, np.array(kinds)[m["followed"][who]], m["id"][who], m["tag"][who], m["start"][who] + a - m["at"][who], b - a)


Judge = Callable[[Shard], tuple[np.ndarray, np.ndarray]]


def _resolve(judge: Judge, within: bool, shard_bytes: int, room: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of CUTS sorted by (anchor, id, tag, start, kind): FOUND rows, shard by shard."""

    def closed(shard: Shard) -> Iterator[pa.RecordBatch]:
        if shard.keys.size:
            yield from _verdicts(shard, *judge(shard), within)
        shard.close()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(room)
        for batch in batches:
            follows = batch.column("kind").to_numpy(zero_copy_only=False) == FOLLOWS
            if follows.any():
                rest = batch.filter(pa.array(follows))
                yield _table(FOUND, np.full(rest.num_rows, FOLLOWER), *_columns(rest, "id", "tag", "start", "n"), rest.column("extra"))
                batch = batch.filter(pa.array(~follows))
            for lo, hi, _, _ in X.chunks(batch.column("body")):
                rows = batch.slice(lo, hi - lo)
                if shard.text.size >= shard_bytes:
                    old = rows.column("anchor").to_numpy(zero_copy_only=False) == shard.anchor
                    same = int(np.argmin(old)) if not old.all() else len(old)
                    if same:
                        shard.add(rows.slice(0, same))
                    if same < len(old):
                        yield from closed(shard)
                        shard, rows = Shard(room), rows.slice(same)
                    else:
                        continue
                shard.add(rows)
        yield from closed(shard)

    return resolve


def _followed(f: np.ndarray, lead: np.ndarray, d: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows [start, end) of followers, with their numbers, that meet the windows [s, e) of the documents ``d`` that lead them."""
    at, n, period = (f[k].astype(np.int64) for k in ("at", "n", "period"))
    wide = int(max(e.max(initial=0), (at + period).max(initial=0))) + 2
    lo = np.searchsorted(d * wide + e, lead * wide + at, "right")
    hi = np.searchsorted(d * wide + s, lead * wide + at + period, "left")
    count = np.maximum(hi - lo, 0)
    k, who = X.gather_ranges(lo, count), np.repeat(np.arange(len(f)), count)
    a, b = np.maximum(s[k] - at[who], 0), np.minimum(e[k] - at[who], period[who])
    # what is met whole goes on over all periods
    whole = b - a == period[who]
    b = np.where(whole, n[who], b)
    turns = np.where(whole, 1, n[who] // period[who])
    turn = np.arange(int(turns.sum())) - np.repeat(np.cumsum(turns) - turns, turns)
    who, a, b = (np.repeat(x, turns) for x in (who, a, b))
    shift = f["start"][who] + turn * period[who]
    return who, shift + a, shift + b


def _settle(window: int, within: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of FOUND rows sorted by (id, tag): spans of units, those of followers included.

    Windows of a follower are removed with those that it follows where these have followers; without ``within``
    a document of the same id is no other, and its windows follow what is removed from the one that leads.
    """

    def whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids, tags = _columns(batch, "id", "tag")
            last = np.flatnonzero((ids != ids[-1]) | (tags != tags[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and (cut or held[-1].column("id")[-1].as_py() != int(ids[0]) or held[-1].column("tag")[-1].as_py() != int(tags[0])):
                if cut:
                    held.append(batch.slice(0, cut))
                yield pa.Table.from_batches(held)
                held = []
            elif cut:
                yield pa.Table.from_batches([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield pa.Table.from_batches(held)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_documents(batches):
            kind, ids, tags, start, n = (rows.column(k).to_numpy() for k in range(5))
            start, n = start.astype(np.int64), n.astype(np.int64)
            doc = np.cumsum(np.append(True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]))) - 1
            head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            own = (kind == OWN) | (kind == BOTH)
            d, s, e = merged(doc[own], start[own], start[own] + n[own] + window - 1)
            yield _table(SPANS, ids[head][d], tags[head][d], s, e - s)
            again, follows = (kind == AGAIN) | (kind == BOTH), np.flatnonzero(kind == FOLLOWER)
            if len(follows) == 0:
                continue
            raw, ends = X.packed(rows.column("extra").combine_chunks().take(pa.array(follows)))
            f = np.frombuffer(raw.tobytes(), FOLLOW)
            lead = np.repeat(doc[follows], np.diff(ends) // FOLLOW.itemsize)
            same = np.zeros(len(f), bool) if within else f["id"] == ids[head][lead]
            parts = []
            for which, use in ((~same, again), (same, own)):
                at = np.flatnonzero(which)
                who, a, b = _followed(f[at], lead[at], *merged(doc[use], start[use], start[use] + n[use]))
                parts.append((at[who], a, b))
            who, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((f["tag"], f["id"]))
            new = (f["id"][order][1:] != f["id"][order][:-1]) | (f["tag"][order][1:] != f["tag"][order][:-1])
            group = np.empty(len(f), np.int64)
            group[order] = np.cumsum(np.append(False, new))
            first = order[np.flatnonzero(np.append(True, new))]
            d, s, e = merged(group[who], a, b + window - 1)
            yield _table(SPANS, f["id"][first[d]], f["tag"][first[d]], s, e - s)

    return settle


def repeated_spans(search: DataFrame, rows: DataFrame, unit: Unit, judge: Judge, shard_bytes: int = SHARD_BYTES, room: int = 4 * SHARD_BYTES) -> DataFrame:
    """Spans (id, tag, start, n) in units that repeat what stands earlier.

    ``search`` are the plain texts, each (id, tag) once, ``rows`` the same with deflated texts; ``judge`` gives the verdicts on a shard (see :func:`_verdicts`).  A shard ends at the first anchor after
    ``shard_bytes`` bytes of text, and holds ``room`` bytes of a kind in memory.
    """
    # a number of its own: adaptive execution must not join partitions that the method works on for long
    shards = int(search.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = search.mapInArrow(X.tidy(_emit_runs(unit)), RUNS)
    runs = runs.repartition("anchor").sortWithinPartitions("anchor", "ctx", "id", "tag", "place").mapInArrow(X.tidy(_classes(unit)), CLASSES)
    per_doc = runs.groupBy("id", "tag").agg(F.collect_list(F.struct("kind", "anchor", "start", "n", "many", "followed", "extra")).alias("runs"))
    rest = [c for c in rows.columns if c == "rest"]
    cuts = rows.join(per_doc, ["id", "tag"]).select("id", "tag", "text", "runs", *rest).mapInArrow(X.tidy(_cut(unit)), CUTS)
    cuts = cuts.repartition(shards, "anchor").sortWithinPartitions("anchor", "id", "tag", "start", "kind")
    found = cuts.mapInArrow(X.tidy(_resolve(judge, unit.within, shard_bytes, room)), FOUND)
    return found.repartition("id", "tag").sortWithinPartitions("id", "tag").mapInArrow(X.tidy(_settle(unit.window, unit.within)), SPANS)


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, tag, text, spans) and what ``rows`` carry: all spans of every row; rows with a null id have none."""
    rest = [c for c in rows.columns if c == "rest"]
    per_doc = spans.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    found = rows.filter(USABLE).join(per_doc, ["id", "tag"], "left").select("id", "tag", "text", "spans", *rest)
    empty = rows.filter("id is null").select("id", "tag", "text", F.lit(None).cast("array<struct<start:int,n:int>>").alias("spans"), *rest)
    return found.unionByName(empty)


def batch_spans(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged spans of a batch of :func:`with_spans`: row number, start, end."""
    lists = batch.column(3)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = lists.flatten()
    doc = np.repeat(np.arange(len(lengths)), lengths)
    start, n = (rows.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
    return merged(doc, start, start + n)
