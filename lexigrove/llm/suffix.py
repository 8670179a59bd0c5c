"""Repeated passages by distributed prefix doubling over the positions of words.

A position's rank of h words is a name that equal runs of h words share. The first names come from FIRST words; a round pairs the name of each position with the
name at the offset h (or as far as LENGTH is left), and the pair makes the name of the run as long as both. Spark moves and sorts the pairs by ranges of their names; a name at one place
only leaves the doubling, with all that would have built on it, so a round works on what still has a partner. Past LENGTH words, those are the repeated windows.
What a task itself finds at several places isn't asked about, and is told to the name's range once: so a name that a third of all positions share costs a range a record per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import slices
from ..storage import checked_broadcast, cut, cut_path, drop
from . import words
from .common import col, fresh, int_text, whole_groups

_U = np.uint64
LENGTH, FIRST = 50, 8
#: Bytes of a name. Names are hashes; two different runs of 8 words among 10**9 share one with probability 0.01, and what is found then also needs the rest of the window to agree.
NAME_BYTES = 7
#: Bytes of text for each range of names and each bucket of documents: what a task holds.
RANGE_BYTES = 8 << 20
#: Records: single places of names to a range (ASK), names at several places of a task to their range (TELL), such places to their documents' bucket (KNOWN).
ASK, TELL, KNOWN = 0, 1, 2
_RECORD = "part int, kind int, data binary"


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of the numbers, first bytes first: what is alike lies together."""
    return np.ascontiguousarray(np.asarray(x).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(data: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<i8").reshape(-1), at + n * width


class Places:
    """Places of words: id and tag of the document, position in it; and the name of what begins there."""

    __slots__ = ("id", "name", "pos", "tag")

    def __init__(self, id: np.ndarray, tag: np.ndarray, pos: np.ndarray, name: np.ndarray) -> None:
        self.id, self.tag, self.pos, self.name = id, tag, pos, name

    def __len__(self) -> int:
        return len(self.pos)

    def take(self, at: np.ndarray) -> Places:
        return Places(self.id[at], self.tag[at], self.pos[at], self.name[at])

    def documents(self) -> np.ndarray:
        """Where a document begins; places lie document by document, ascending."""
        begins = np.ones(len(self), bool)
        begins[1:] = (self.id[1:] != self.id[:-1]) | (self.tag[1:] != self.tag[:-1]) | (self.pos[1:] <= self.pos[:-1])
        return begins

    def ordered(self) -> Places:
        """By document and position, each place once."""
        out = self.take(np.lexsort((self.pos, self.tag, self.id)))
        new = np.ones(len(out), bool)
        new[1:] = (out.id[1:] != out.id[:-1]) | (out.tag[1:] != out.tag[:-1]) | (out.pos[1:] != out.pos[:-1])
        return out if new.all() else out.take(np.flatnonzero(new))

    def to_bytes(self) -> bytes:
        begins = self.documents()
        first = np.flatnonzero(begins)
        step = np.diff(self.pos, prepend=0)
        step[first] = self.pos[first]
        head = np.array([len(self), len(first)], np.int64).tobytes()
        return head + _planes(self.id[first], 8) + _planes(self.tag[first], 4) + _planes(np.diff(np.append(first, len(self))), 4) + _planes(step, 4) + _planes(self.name, NAME_BYTES)

    @classmethod
    def from_bytes(cls, data: bytes) -> Places:
        n, d = (int(x) for x in np.frombuffer(data, np.int64, 2))
        ids, at = _numbers(data, 16, d, 8)
        tag, at = _numbers(data, at, d, 4)
        count, at = _numbers(data, at, d, 4)
        step, at = _numbers(data, at, n, 4)
        name, _ = _numbers(data, at, n, NAME_BYTES)
        total = np.cumsum(step)
        first = np.cumsum(count) - count
        base = total[first] - step[first] if n else total
        return cls(np.repeat(ids, count), np.repeat(tag, count), total - np.repeat(base, count), name)

    @classmethod
    def joined(cls, parts: list[Places]) -> Places:
        return cls(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("id", "tag", "pos", "name")))


def _names(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - 8 * NAME_BYTES)).astype(np.int64)


def _range_of(name: np.ndarray, bits: int) -> np.ndarray:
    return name >> (8 * NAME_BYTES - bits)


def _bucket_of(places: Places, bits: int) -> np.ndarray:
    mixed = words.mix(places.id.astype(np.int64).view(_U) + places.tag.astype(_U) * _U(0x9E3779B97F4A7C15))
    return (mixed & _U((1 << bits) - 1)).astype(np.int64)


def _split(which: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by a number below 2**bits, the numbers that occur, and where each one's run begins and ends."""
    order = np.argsort(which.astype(np.uint16 if bits <= 16 else np.uint32), kind="stable")
    cuts = np.searchsorted(which[order], np.arange((1 << bits) + 1))
    return order, np.flatnonzero(np.diff(cuts)), cuts


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, data = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["part", "kind", "data"])


def _asked(places: Places, bits: int) -> pa.RecordBatch:
    """Records of the named places of a task, which lie by document and position."""
    n = len(places)
    order = np.argsort(places.name, kind="stable")
    name = places.name[order]
    begins = np.ones(n, bool)
    begins[1:] = name[1:] != name[:-1]
    begin = np.flatnonzero(begins)
    several = np.diff(np.append(begin, n)) > 1
    many = np.zeros(n, bool)
    many[order] = np.repeat(several, np.diff(np.append(begin, n)))
    rows = []
    for kind, chosen, where in ((ASK, places.take(np.flatnonzero(~many)), _range_of), (KNOWN, places.take(np.flatnonzero(many)), None)):
        number = where(chosen.name, bits) if where else _bucket_of(chosen, bits)
        by, present, cuts = _split(number, bits)
        chosen = chosen.take(by)
        rows += [(int(k), kind, chosen.take(slice(cuts[k], cuts[k + 1])).to_bytes()) for k in present]
    told = name[begin[several]]
    _, present, cuts = _split(_range_of(told, bits), bits)
    rows += [(int(k), TELL, _planes(told[cuts[k] : cuts[k + 1]], NAME_BYTES)) for k in present]
    return _batch(rows)


def _first_names(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 4 << 20):
                ids, tags = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                # rows of one id and text are one document
                once = np.zeros(part.num_rows, bool)
                once[np.unique(np.stack([ids, tags]), axis=1, return_index=True)[1]] = True
                _, _, w = words.scan(part.column(2))
                size = np.diff(w.first)
                name = _names(words.gram_hashes(w.code, FIRST))
                ok = words.whole(w.first, FIRST, len(w.code)) & np.repeat((size >= LENGTH) & once, size)[: len(name)]
                at = np.flatnonzero(ok)
                row = np.repeat(np.arange(len(size)), size)[at]
                if len(at):
                    yield _asked(Places(ids[row], tags[row] & 0xFFFFFFFF, at - w.first[row], name[at]), bits)

    return run


def _next_names(step: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                places = Places.from_bytes(data.as_py())
                key = (np.cumsum(places.documents()) << 32) | places.pos
                there = np.searchsorted(key, key + step)
                at = np.flatnonzero(key[np.minimum(there, len(key) - 1)] == key + step)
                if len(at):
                    left, right = places.name[at].view(_U), places.name[there[at]].view(_U)
                    pair = words.mix(words.mix(left * _U(0x9E3779B97F4A7C15) + _U(step)) + right * _U(0xD1342543DE82EF95))
                    yield _asked(Places(places.id[at], places.tag[at], places.pos[at], _names(pair)), bits)

    return run


def _rerank(bits: int):
    """Records sorted by range to the places whose name is at several, for the documents' buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "part"):
            kind = table["kind"].to_numpy()
            data = table["data"]
            rows = [(int(table["part"][k].as_py()), KNOWN, data[k].as_py()) for k in np.flatnonzero(kind == KNOWN).tolist()]
            if rows:
                yield _batch(rows)
            part = table["part"].to_numpy()
            for one in np.unique(part):
                mine = part == one
                asks = [Places.from_bytes(data[k].as_py()) for k in np.flatnonzero(mine & (kind == ASK)).tolist()]
                if not asks:
                    continue
                told = [_numbers(data[k].as_py(), 0, len(data[k].as_py()) // NAME_BYTES, NAME_BYTES)[0] for k in np.flatnonzero(mine & (kind == TELL)).tolist()]
                places = Places.joined(asks)
                del asks
                order = np.argsort(places.name)
                name = places.name[order]
                begins = np.ones(len(order), bool)
                begins[1:] = name[1:] != name[:-1]
                begin = np.flatnonzero(begins)
                size = np.diff(np.append(begin, len(order)))
                tied = size > 1
                if told:
                    known = np.unique(np.concatenate(told))
                    tied |= known[np.minimum(np.searchsorted(known, name[begin]), len(known) - 1)] == name[begin]
                live = places.take(order[np.repeat(tied, size)])
                if len(live):
                    live = live.ordered()
                    by, present, cuts = _split(_bucket_of(live, bits), bits)
                    live = live.take(by)
                    yield _batch([(int(k), KNOWN, live.take(slice(cuts[k], cuts[k + 1])).to_bytes()) for k in present])

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records sorted by bucket to one record of all places of a bucket."""
    for table in whole_groups(batches, "part"):
        part = table["part"].to_numpy()
        for one in np.unique(part):
            places = Places.joined([Places.from_bytes(table["data"][k].as_py()) for k in np.flatnonzero(part == one).tolist()]).ordered()
            yield _batch([(int(one), KNOWN, places.to_bytes())])


def _least(bits: int):
    """A bucket's places to records for the ranges: each name once, with its first place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                places = Places.from_bytes(data.as_py())
                first = places.take(np.unique(places.name, return_index=True)[1])
                _, present, cuts = _split(_range_of(first.name, bits), bits)
                yield _batch([(int(k), bucket, first.take(slice(cuts[k], cuts[k + 1])).to_bytes()) for k in present])

    return run


def _origins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of _least sorted by range to answers for each bucket: the names, each with its first place of all."""
    for table in whole_groups(batches, "part"):
        part, asker = table["part"].to_numpy(), table["kind"].to_numpy()
        for one in np.unique(part):
            mine = np.flatnonzero(part == one).tolist()
            asked = [Places.from_bytes(table["data"][k].as_py()) for k in mine]
            places = Places.joined(asked)
            order = np.lexsort((places.pos, places.tag, places.id, places.name))
            name = places.name[order]
            begins = np.ones(len(order), bool)
            begins[1:] = name[1:] != name[:-1]
            first = np.empty(len(order), np.int64)
            first[order] = order[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
            first = places.take(first)
            end = 0
            for k, x in zip(mine, asked, strict=True):
                begin, end = end, end + len(x)
                yield _batch([(int(asker[k]), ASK, first.take(slice(begin, end)).to_bytes())])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's places (KNOWN) and the first places of their names (ASK) to spans of first and of later windows."""
    for table in whole_groups(batches, "part"):
        part, kind, data = table["part"].to_numpy(), table["kind"].to_numpy(), table["data"]
        for one in np.unique(part):
            mine = part == one
            held = [Places.from_bytes(data[k].as_py()) for k in np.flatnonzero(mine & (kind == KNOWN)).tolist()]
            if not held:
                continue
            places = Places.joined(held)
            origin = Places.joined([Places.from_bytes(data[k].as_py()) for k in np.flatnonzero(mine & (kind == ASK)).tolist()])
            origin = origin.take(np.argsort(origin.name))
            origin = origin.take(np.searchsorted(origin.name, places.name))
            later = (origin.id != places.id) | (origin.tag != places.tag) | (origin.pos != places.pos)
            order = np.lexsort((places.pos, later, places.tag, places.id))
            places, later, source = places.take(order), later[order], origin.id[order]
            begins = np.ones(len(places), bool)
            begins[1:] = (places.id[1:] != places.id[:-1]) | (places.tag[1:] != places.tag[:-1]) | (later[1:] != later[:-1]) | (places.pos[1:] > places.pos[:-1] + LENGTH)
            a = np.flatnonzero(begins)
            b = np.append(a[1:], len(places)) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(places.id[a]), pa.array(places.tag[a]), pa.array(places.pos[a].astype(np.int32)), pa.array((places.pos[b] + LENGTH).astype(np.int32)), pa.array(~later[a]), pa.array(np.minimum.reduceat(source, a))],
                ["doc_id", "tag", "start_word", "end_word", "first", "first_doc_id"],
            )


def _ranged(records: DataFrame, bits: int) -> DataFrame:
    """Records at the task of their part, sorted."""
    return records.repartitionById(1 << bits, F.col("part")).sortWithinPartitions("part")


#: Tells texts of one id apart.
_TAG = "cast(xxhash64(text) & 4294967295 as long)"


def tagged_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """repeated_spans(), with the tag of the text."""
    plain = int_text(docs, id_col, text_col).where("id is not null and text is not null").selectExpr("id", f"{_TAG} as tag", "text")
    size = plain.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(0, (size - 1) // RANGE_BYTES).bit_length()
    records, h, path = plain.mapInArrow(_first_names(bits), _RECORD), FIRST, None
    while True:
        kept = _ranged(_ranged(records, bits).mapInArrow(_rerank(bits), _RECORD), bits).mapInArrow(_gather, _RECORD)
        state, written = cut_path(kept)
        if path:
            drop(docs.sparkSession, path)
        path = written
        if h == LENGTH:
            break
        step = min(h, LENGTH - h)
        records, h = state.mapInArrow(_next_names(step, bits), _RECORD), h + step
    first = _ranged(state.mapInArrow(_least(bits), _RECORD), bits).mapInArrow(_origins, _RECORD)
    return _ranged(state.unionByName(first), bits).mapInArrow(_spans, "doc_id long, tag long, start_word int, end_word int, first boolean, first_doc_id long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of words covered by windows of LENGTH words that occur more than once in all texts.

    (doc_id, start_word, end_word, first, first_doc_id): words are runs of anything but ASCII white space, counted from 0, the end exclusive.
    first: the span is made of windows that occur here first (least id, then least place); the other spans are made of later occurrences,
    and first_doc_id is the least id in which one of their windows occurs first. A text may repeat a window within itself, and be of any length. Null and empty texts,
    texts of fewer words and rows with a null id have no spans. Rows that repeat an id with its text are one document; rows of one id with different texts are
    documents apart. An empty table gives no rows.
    """
    return tagged_spans(docs, id_col, text_col).drop("tag")


def without_spans(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without the words of the given sorted disjoint spans and the white space behind each."""
    raw = text.encode()
    data, offsets = words.text_buffer(pa.array([text]))
    start, _, _ = words.word_spans(data, offsets)
    bounds = np.append(start, len(raw))
    out, at = [], 0
    for a, b in cuts:
        a, b = min(a, len(start)), min(b, len(start))
        out.append(raw[at : max(at, bounds[a])])
        at = max(at, int(bounds[b]))
    return (b"".join(out) + raw[at:]).decode()


def removable(spans: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """Words of later spans that no first span covers."""
    kept = sorted((a, b) for a, b, first in spans if first)
    out = []
    for a, b in sorted((a, b) for a, b, first in spans if not first):
        for x, y in kept:
            if y <= a or x >= b:
                continue
            if x > a:
                out.append((a, x))
            a = max(a, y)
        if a < b:
            out.append((a, b))
    return out


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, tag, spans) the documents that have removable words, with these."""
    for batch in batches:
        found = [removable([(s["start"], s["end"], s["first"]) for s in x]) for x in batch.column(2).to_pylist()]
        on = [i for i, x in enumerate(found) if x]
        cuts = [[{"start": a, "end": b} for a, b in found[i]] for i in on]
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(on, pa.int64())) for k in (0, 1)), pa.array(cuts, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], batch.schema.names)


def _cutter(text_at: int, spans_at: int):
    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(spans_at)
            texts = batch.column(text_at)
            keep = np.ones(batch.num_rows, bool)
            if lists.null_count < len(lists):
                out = texts.to_pylist()
                for i in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)):
                    cuts = [(s["start"], s["end"]) for s in lists[int(i)].as_py()]
                    if out[i] is not None:
                        out[i] = without_spans(out[i], cuts)
                        keep[i] = bool(out[i].strip())
                texts = pa.array(out, texts.type)
            columns = [texts if i == text_at else c for i, c in enumerate(batch.columns) if i != spans_at]
            names = [n for i, n in enumerate(batch.schema.names) if i != spans_at]
            done = pa.RecordBatch.from_arrays(columns, names)
            yield done if keep.all() else done.filter(pa.array(keep))

    return cut_texts


def _pass(docs: DataFrame, lists: DataFrame, id_col: str, text_col: str, length_col: str | None) -> DataFrame:
    """docs without the words of lists: (key, tag, spans) of documents."""
    key, tag, spans = lists.columns
    lists = checked_broadcast(lists, 200)
    same = (col(docs, id_col).cast("long") == lists[key]) & (F.xxhash64(col(docs, text_col).cast("string")).bitwiseAND(F.lit(0xFFFFFFFF)) == lists[tag])
    joined = docs.join(lists, same, "left").select(*[col(docs, c) for c in docs.columns], spans)
    at = docs.columns.index(next(c for c in docs.columns if c.lower() == text_col.lower()))
    done = joined.mapInArrow(_cutter(at, len(docs.columns)), docs.schema)
    if length_col and length_col in docs.columns:
        n = col(done, length_col)
        kind = docs.schema[length_col].dataType
        done = done.withColumn(length_col, F.when(n.isNotNull(), F.length(col(done, text_col)).cast(kind)))
    return done


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with the later occurrences of repeated passages taken out of their texts; first occurrences stay.

    A pass spares words that a first window of the same document covers, which may keep a passage whole beside its first occurrence, and what it joins may repeat
    a passage anew; so passes go on until they find nothing to take out. No window is left twice then, but in rows that repeat an id with its text: a pass takes out at least the last word of the last repeated one.
    A document of which no word is left goes. length_col, if docs has it and it isn't null, is set to the length of the text. The rest stays as it is; see repeated_spans for nulls and ties.
    """
    spans, key, tag = fresh(docs, "cut_spans", "cut_key", "cut_tag")
    struct = F.struct(F.col("start_word").alias("start"), F.col("end_word").alias("end"), "first")
    path = None
    while True:
        found = tagged_spans(docs, id_col, text_col)
        lists = found.groupBy(F.col("doc_id").alias(key), F.col("tag").alias(tag)).agg(F.collect_list(struct).alias(spans), F.max(~F.col("first")).alias("later")).where("later").drop("later")
        lists = cut(lists.mapInArrow(_cuts, f"`{key}` long, `{tag}` long, `{spans}` array<struct<start: int, end: int>>"))
        if lists.isEmpty():
            return docs
        docs, done = cut_path(_pass(docs, lists, id_col, text_col, length_col))
        if path:
            drop(docs.sparkSession, path)
        path = done
