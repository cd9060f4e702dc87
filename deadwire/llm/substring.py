"""Substring deduplication by De Bruijn compaction.

Token k-mers are the edges of a De Bruijn graph whose paths are texts; a passage that
stands in several places is a path that is walked several times. Every window of
``span`` words holds span - k + 1 k-mers, and the one with the smallest hash is its anchor:
equal windows choose equal anchors, so a graph of the anchors alone (about a seventh of
the k-mers) still meets every repeated window. The windows around one anchor
occurrence form a run, the unit of the graph here.

1. ``_runs`` (Arrow stage): anchor hash, hash of all words of the run, source coordinates.
   A run that is found again inside one batch is settled there (``_agreeing`` chains such runs into paths and compares
   their words with those of the earlier place), and so is an anchor that
   branches inside one batch: it sends two marks, and its runs go straight to step 3 (map-side
   combine, so a hot passage gives a row or two per batch and not one per copy).
2. One shuffle by anchor. An anchor met once is dropped. If all its runs have the same
   words it is nonbranching: every run but the first in source order is gone as a whole.
   If not, its runs branch and go on window by window.
3. Branching runs are joined to their documents; their windows are compared by 128 bits
   of hash, again with a combine per batch and one shuffle.
4. Compaction (``_paths``): a gone edge carries the source coordinates of the place it repeats. A node where one
   such edge ends and the next begins, in both documents, is inner; the nodes left are the ends of the maximal
   nonbranching paths, and a join pairs them. Paths are cut where the earlier place's word number is a multiple
   of ``PIECE``, so that copies with ragged edges share their inner pieces.
5. Verification (``_digests``): each distinct earlier piece is read from its document through the coordinates and its
   words are hashed by SHA-256, once however often it is repeated. The digest is joined to the pieces that repeat it;
   these are joined to their documents, and only a piece whose own words have the same digest is cut out. A piece that
   differs (its 128 bits of hash met by chance) stays.

A document is named by its id and 128 bits of hash of its text (``th``, ``tk``), in every join,
group and order: many different texts may stand under one id (a null one, say).

Order of occurrences: (id, text hash, start), null ids first. Rows with equal id and equal
text are one document and share their fate.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deadwire.llm.common import materialize, text_chunks, tidy
from deadwire.llm.words import Words, hash_words, mix, normalized, rolling, spread, split_words

SPAN, KMER = 20, 8
_BASE, _OTHER = 0x2545F4914F6CDD1B, 0xD6E8FEB86659FD93
_NULL_ID = -(1 << 63)
#: What names a document: its id and two hashes of its text.
DOC = ("id", "th", "tk")
#: The place that a gone edge repeats.
LEAD = ("lid", "lth", "ltk", "lstart")
#: Windows of a piece of a path.
PIECE = 1024


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _valid(words: Words, span: int) -> np.ndarray:
    """For each word: whether a window of ``span`` words of one text starts there."""
    ends = np.repeat(words.first[1:], words.counts)
    return np.arange(len(words.starts)) + span <= ends


def find_runs(words: Words, span: int, kmer: int) -> tuple[np.ndarray, ...]:
    """(anchor, hash of the run's words, first window, windows) of each run of windows of
    one text that share an anchor occurrence."""
    hashes, none = hash_words(words), np.zeros(0, np.uint64)
    n, wide = len(hashes) - span + 1, span - kmer + 1
    if n <= 0:
        return none, none, np.zeros(0, np.int64), np.zeros(0, np.int64)
    kmers = mix(rolling(hashes, kmer))
    least, reach = kmers, 1
    while reach < wide:  # minimum over 1, 2, 4 ... k-mers
        step = min(reach, wide - reach)
        least = np.minimum(least[:len(least) - step], least[step:])
        reach += step
    at = np.zeros(n, np.int64)
    for j in reversed(range(wide)):  # the leftmost k-mer with that hash
        at[kmers[j:j + n] == least[:n]] = j
    at += np.arange(n)
    ok = np.flatnonzero(_valid(words, span)[:n])
    if not len(ok):
        return none, none, np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = words.doc_of()[ok]
    new = np.concatenate([[True], (at[ok[1:]] != at[ok[:-1]]) | (doc[1:] != doc[:-1])])
    begin = np.flatnonzero(new)
    first, size = ok[begin], np.diff(np.append(begin, len(ok)))
    anchor = kmers[at[first]]
    # polynomial hash of the words first .. first + size + span - 2
    power = _powers(_BASE, len(hashes) + 1)
    inverse = _powers(pow(_BASE, -1, 1 << 64), len(hashes) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1], dtype=np.uint64)])
    whole = (total[first + size + span - 1] - total[first]) * inverse[first]
    shape = (size.astype(np.uint64) << np.uint64(32)) | (at[first] - first).astype(np.uint64)
    return anchor, mix(whole ^ mix(shape)), first, size


def _leaders(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each item the one with equal keys and the smallest (doc, start); itself if it has that place."""
    order = np.lexsort((start, doc, *keys))
    same = np.ones(len(order), bool)
    same[:1] = False
    for k in keys:
        same[1:] &= k[order[1:]] == k[order[:-1]]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    out = np.zeros(len(order), np.int64)
    out[order] = order[head]
    moved = (doc != doc[out]) | (start != start[out])
    return np.where(moved, out, np.arange(len(out)))


def _agreeing(words: Words, first: np.ndarray, size: np.ndarray, lead: np.ndarray, doc: np.ndarray,
              span: int) -> np.ndarray:
    """Which items (windows first .. first + size - 1 of a text ``doc``) have a lead other than themselves and the same
    words as it. Items that follow one another as their leads do are compared as one path."""
    out = np.zeros(len(first), bool)
    at = np.flatnonzero(lead != np.arange(len(first)))
    if not len(at):
        return out
    at = at[np.argsort(first[at], kind="stable")]
    data, starts, ends = normalized(words)
    begin, shift, stop = first[at], first[lead[at]] - first[at], first[at] + size[at]
    new = np.ones(len(at), bool)
    new[1:] = ((begin[1:] != stop[:-1]) | (shift[1:] != shift[:-1]) | (doc[at[1:]] != doc[at[:-1]])
               | (doc[lead[at[1:]]] != doc[lead[at[:-1]]]))
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    for h, t in zip(heads.tolist(), tails.tolist()):
        a, b, d = begin[h], stop[t] + span - 2, shift[h]
        out[at[h:t + 1]] = np.array_equal(data[starts[a]:ends[b]], data[starts[a + d]:ends[b + d]])
    return out


def _place(batch: pa.RecordBatch, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, both text hashes, rank of the row's (id, text hashes) in the batch)."""
    named = [np.asarray(batch.column(k).slice(a, b - a)) for k in range(3)]
    rows = np.zeros(len(named[0]), [(c, np.int64) for c in DOC])
    for c, values in zip(DOC, named):
        rows[c] = values
    _, rank = np.unique(rows, return_inverse=True)
    return *named, rank


def _once(rank: np.ndarray) -> np.ndarray:
    """The rows of a batch that are the first of their document; rows that repeat one add nothing."""
    out = np.zeros(len(rank), bool)
    out[np.unique(rank, return_index=True)[1]] = True
    return out


#: Kinds of rows of ``_runs``: a run whose anchor has no other words around it in its batch; the two outermost runs
#: of an anchor that has; each run of such an anchor, under a key of its own; spans settled in the batch.
ALONE, MARK, FORK, GONE = range(4)
_RUN = "anchor bigint, run bigint, id bigint, th bigint, tk bigint, start bigint, size int, kind tinyint"


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _merge(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of one document become one."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    if not len(doc):
        return doc, start, stop
    far = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + doc * far) - doc * far
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])])
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1]


def _keyed(docs: DataFrame, id_col: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    words = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID).cast("long")).alias("id"),
                       F.xxhash64(words).alias("th"), F.xxhash64(F.lit(_OTHER >> 1), words).alias("tk"),
                       words.alias("text"),
                       *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)))


def _runs(keyed: DataFrame, span: int, kmer: int) -> DataFrame:
    names = ["anchor", "run", *DOC, "start", "size", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for a, b in text_chunks(batch.column(3)):
                words = split_words(batch.column(3).slice(a, b - a))
                anchor, whole, first, size = find_runs(words, span, kmer)
                if not len(first):
                    continue
                ids, th, tk, rank = _place(batch, a, b)
                doc = np.searchsorted(words.first, first, side="right") - 1
                own = _once(rank)[doc]
                anchor, whole, first, size, doc = (x[own] for x in (anchor, whole, first, size, doc))
                start = first - words.first[doc]
                later = _agreeing(words, first, size, _leaders([anchor, whole], rank[doc], start), doc, span)
                on, off = np.flatnonzero(~later), np.flatnonzero(later)
                on = on[np.lexsort((whole[on], anchor[on]))]
                same = anchor[on[1:]] == anchor[on[:-1]]
                lowest, highest = np.append(True, ~same)[:len(on)], np.append(~same, True)[:len(on)]
                forks = ~(lowest & highest)  # of an anchor with other words around it in this batch
                place = mix(ids[doc].view(np.uint64) ^ mix(start.astype(np.uint64)))
                for kind, rows, key in ((ALONE, on[~forks], anchor), (MARK, on[forks & (lowest | highest)], anchor),
                                        (FORK, on[forks], place)):
                    yield _batch([key[rows].view(np.int64), whole[rows].view(np.int64), ids[doc[rows]], th[doc[rows]],
                                  tk[doc[rows]], start[rows], size[rows].astype(np.int32),
                                  np.full(len(rows), kind, np.int8)], names)
                d, s, e = _merge(doc[off], start[off], start[off] + size[off])
                if len(d):
                    spot = mix(d.astype(np.uint64) ^ mix(ids[d].view(np.uint64))).view(np.int64)
                    yield _batch([spot, spot, ids[d], th[d], tk[d], s, (e - s).astype(np.int32),
                                  np.full(len(d), GONE, np.int8)], names)

    return keyed.mapInArrow(run, _RUN)


def _blobs(keyed: DataFrame) -> DataFrame:
    """``keyed`` with its texts as zstandard frames, for the joins."""
    carried = keyed.columns[4:]
    schema = keyed.drop("text").schema.add("blob", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for a, b in text_chunks(batch.column(3)):
                part = batch.column(3).slice(a, b - a).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(a, b - a) for k in (0, 1, 2, *range(4, 4 + len(carried)))]
                    + [pa.array([packer.compress(t) for t in part], pa.binary())],
                    names=[*DOC, *carried, "blob"])

    return keyed.select(*DOC, "text", *carried).mapInArrow(run, schema)


def _texts(blobs: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    """(begin, end, texts) of bounded parts of a column of frames."""
    reader = zstandard.ZstdDecompressor()
    for a, b in text_chunks(blobs, 1 << 20):
        yield a, b, pa.array([reader.decompress(x) for x in blobs.slice(a, b - a).to_pylist()], pa.large_binary())


def _lists(column: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """(row of each item, its fields ...) of a column of arrays of structs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    return (np.repeat(np.arange(len(column)), sizes),
            *(np.asarray(flat.field(flat.type.get_field_index(n))) for n in names))


def _windows(keyed: DataFrame, mixed: DataFrame, span: int) -> DataFrame:
    """Branching runs window by window: (w1, w2, id, th, tk, start, size, gone)."""
    names = ["w1", "w2", *DOC, "start", "size", "gone"]
    listed = mixed.groupBy(*DOC).agg(F.collect_set(F.struct("start", "size")).alias("runs"))
    joined = _blobs(keyed).join(listed, list(DOC))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for a, b, texts in _texts(batch.column(3)):
                words = split_words(texts)
                hashes = hash_words(words)
                owner, begin, count = _lists(batch.column(4).slice(a, b - a), ("start", "size"))
                at = np.unique(spread(words.first[owner] + begin, count.astype(np.int64)))
                ids, th, tk, rank = _place(batch, a, b)
                doc = np.searchsorted(words.first, at, side="right") - 1
                own = _once(rank)[doc]
                at, doc = at[own], doc[own]
                start = at - words.first[doc]
                w1, w2 = mix(rolling(hashes, span))[at], mix(rolling(hashes, span, _OTHER))[at]
                later = _agreeing(words, at, np.ones(len(at), np.int64), _leaders([w1, w2], rank[doc], start), doc, span)
                on, off = np.flatnonzero(~later), np.flatnonzero(later)
                yield _batch([w1[on].view(np.int64), w2[on].view(np.int64), ids[doc[on]], th[doc[on]], tk[doc[on]],
                              start[on], np.ones(len(on), np.int32), np.zeros(len(on), bool)], names)
                d, s, e = _merge(doc[off], start[off], start[off] + 1)
                if len(d):
                    spot = mix(d.astype(np.uint64) ^ mix(ids[d].view(np.uint64))).view(np.int64)
                    yield _batch([spot, s, ids[d], th[d], tk[d], s, (e - s).astype(np.int32), np.ones(len(d), bool)],
                                 names)

    return joined.select(*DOC, "blob", "runs").mapInArrow(
        run, "w1 bigint, w2 bigint, id bigint, th bigint, tk bigint, start bigint, size int, gone boolean")


def _edges(keyed: DataFrame, span: int, kmer: int) -> DataFrame:
    """(id, th, tk, start, size, *LEAD): edges that also stand earlier, at the place LEAD (null where their batch has
    settled them)."""
    same = Window.partitionBy("anchor")
    place = F.struct(*DOC, "start")
    kind = F.col("kind")
    from_lead = [F.when(F.col("led"), F.col(f"lead.{c}")).alias(n) for c, n in zip((*DOC, "start"), LEAD)]
    met = (_runs(keyed, span, kmer)
           .withColumn("n", F.count(F.when(kind.isin(ALONE, MARK), 1)).over(same))
           .withColumn("low", F.min("run").over(same)).withColumn("high", F.max("run").over(same))
           .withColumn("lead", F.min(F.when(kind == ALONE, place)).over(same))
           .where(kind.isin(FORK, GONE) | ((kind == ALONE) & (F.col("n") > 1)))
           .withColumn("mixed", (kind == FORK) | ((kind == ALONE) & (F.col("low") != F.col("high"))))
           .where((kind == GONE) | F.col("mixed") | (place != F.col("lead")))
           .withColumn("led", (kind == ALONE) & ~F.col("mixed"))
           .select(*DOC, "start", "size", "mixed", *from_lead))
    met = materialize(met, "runs")
    windows = _windows(keyed, met.where("mixed"), span)
    same = Window.partitionBy("w1", "w2")
    later = (windows.withColumn("lead", F.min(F.when(~F.col("gone"), place)).over(same))
             .where(F.col("gone") | (place != F.col("lead"))).withColumn("led", ~F.col("gone"))
             .select(*DOC, "start", "size", *from_lead))
    return met.where("not mixed").drop("mixed").unionByName(later)


def _paths(edges: DataFrame, piece: int = PIECE) -> DataFrame:
    """The edges with a lead as maximal nonbranching paths, in pieces: (id, th, tk, start, size, *LEAD).

    Edges of one document do not overlap, so the ends of its paths along one lead alternate: the n-th
    beginning belongs to the n-th end. Repeated edges count once."""
    line = [*DOC, *LEAD[:3], "shift"]
    ends = F.array(F.struct(F.col("start").alias("at"), F.lit(True).alias("opens")),
                   F.struct((F.col("start") + F.col("size")).alias("at"), F.lit(False).alias("opens")))
    nodes = (edges.where(F.col("lid").isNotNull()).withColumn("shift", F.col("lstart") - F.col("start"))
             .select(*line, F.explode(ends).alias("node")).groupBy(*line, F.col("node.at").alias("at"))
             .agg(F.min("node.opens").alias("opens"), F.max("node.opens").alias("some"))
             .where("opens = some")  # an inner node both ends and begins an edge
             .withColumn("n", F.row_number().over(Window.partitionBy(*line, "opens").orderBy("at"))))
    whole = (nodes.where("opens").select(*line, "n", F.col("at").alias("begin"))
             .join(nodes.where("not opens").select(*line, "n", F.col("at").alias("stop")), [*line, "n"]))
    low, high = F.col("begin") + F.col("shift"), F.col("stop") + F.col("shift")
    cuts = F.sequence((low / piece).cast("long"), ((high - 1) / piece).cast("long"))
    return (whole.withColumn("low", low).withColumn("high", high).withColumn("cut", F.explode(cuts))
            .withColumn("lstart", F.greatest("low", F.col("cut") * piece))
            .withColumn("size", (F.least("high", (F.col("cut") + 1) * piece) - F.col("lstart")).cast("int"))
            .select(*DOC, (F.col("lstart") - F.col("shift")).alias("start"), "size", *LEAD))


def _digest(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, n: int) -> bytes:
    """SHA-256 of the words first .. first + n - 1 of ``normalized`` text, one space between them."""
    return hashlib.sha256(data[starts[first]:ends[first + n - 1]]).digest()


def _check(words: Words, owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
    if len(owner) and (start.min() < 0 or np.any(stop > words.counts[owner])):
        raise ValueError("a span lies outside its document")


def _digests(keyed: DataFrame, pieces: DataFrame, span: int) -> DataFrame:
    """(*LEAD, size, digest): the words of each distinct earlier place, read from its document."""
    wanted = (pieces.select(*(F.col(a).alias(b) for a, b in zip(LEAD, DOC)), F.struct(F.col("lstart").alias("start"), "size").alias("p"))
              .groupBy(*DOC).agg(F.collect_set("p").alias("places")))
    joined = _blobs(keyed).join(wanted, list(DOC))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for a, b, texts in _texts(batch.column(3)):
                words = split_words(texts)
                owner, start, size = _lists(batch.column(4).slice(a, b - a), ("start", "size"))
                ids, th, tk, rank = _place(batch, a, b)
                own = _once(rank)[owner]
                owner, start, size = owner[own], start[own], size[own].astype(np.int64)
                _check(words, owner, start, start + size + span - 1)
                data, starts, ends = normalized(words)
                found = [_digest(data, starts, ends, f, n) for f, n in
                         zip((words.first[owner] + start).tolist(), (size + span - 1).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (ids[owner], th[owner], tk[owner], start, size.astype(np.int32))]
                    + [pa.array(found, pa.binary())], names=[*LEAD, "size", "digest"])

    schema = "lid bigint, lth bigint, ltk bigint, lstart bigint, size int, digest binary"
    out = joined.select(*DOC, "blob", "places").mapInArrow(run, schema)
    return out.groupBy(*LEAD, "size").agg(F.min("digest").alias("digest"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", span: int = SPAN,
                   kmer: int = KMER, piece: int = PIECE) -> DataFrame:
    """(id, th, tk, start, size, digest): windows start .. start + size - 1 (in words) of a document that also
    stand earlier, and the SHA-256 of the words there (null where the batch that found the span has compared them).
    ``id`` is the integer id (null: the smallest long), ``th`` and ``tk`` its text's hashes."""
    keyed = _keyed(docs, id_col, text)
    edges = materialize(_edges(keyed, span, kmer), "edges")
    pieces = materialize(_paths(edges, piece), "paths")
    led = pieces.join(_digests(keyed, pieces, span), [*LEAD, "size"]).select(*DOC, "start", "size", "digest")
    return led.unionByName(edges.where(F.col("lid").isNull())
                           .select(*DOC, "start", "size", F.lit(None).cast("binary").alias("digest")))


def _removed(words: Words, owner: np.ndarray, start: np.ndarray, size: np.ndarray, digest: np.ndarray,
             span: int) -> np.ndarray:
    """For each word: whether a gone window covers it whose words are those of the earlier place. Coordinates outside a
    text are an error."""
    stop = start + size + span - 1
    _check(words, owner, start, stop)
    first, told = words.first[owner], np.array([x is not None for x in digest.tolist()], bool)
    same = np.ones(len(owner), bool)
    if told.any():
        data, starts, ends = normalized(words)
        for i in np.flatnonzero(told).tolist():
            same[i] = _digest(data, starts, ends, first[i] + start[i], int(stop[i] - start[i])) == digest[i]
    edge = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(edge, (first + start)[same], 1)
    np.add.at(edge, (first + stop)[same], -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", span: int = SPAN, kmer: int = KMER,
                   layout: bool = False, carry: tuple[str, ...] = (), piece: int = PIECE) -> DataFrame:
    """(id, th, tk, text, n_words, n_removed, *carry): every document without the words that a window of
    ``span`` words covers which also stands earlier.

    ``id``, ``th`` and ``tk`` as in ``repeated_spans``. The text is the kept words joined by one space; with ``layout``
    it is the original text, each removed word taken out together with the white space
    after it. A null or empty text has no words and stays empty; an empty table gives no rows."""
    keyed = _keyed(docs, id_col, text, carry)
    carried = [f"carried_{i}" for i in range(len(carry))]
    schema = "id bigint, th bigint, tk bigint, text string, n_words bigint, n_removed bigint"
    for c, name in zip(carry, carried):
        schema += f", {name} {docs.schema[c].dataType.simpleString()}"
    spans = repeated_spans(docs, id_col, text, span, kmer, piece)
    listed = spans.groupBy(*DOC).agg(F.collect_set(F.struct("start", "size", "digest")).alias("spans"))
    joined = _blobs(keyed).join(listed, list(DOC), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for a, b, texts in _texts(batch.column(3)):
                words = split_words(texts)
                gone = _removed(words, *_lists(batch.column(4).slice(a, b - a), ("start", "size", "digest")), span)
                out = _rebuilt(words, gone, layout)
                lost = np.concatenate([[0], np.cumsum(gone)])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, b - a) for k in range(3)), out,
                     pa.array(words.counts.astype(np.int64)),
                     pa.array((lost[words.first[1:]] - lost[words.first[:-1]]).astype(np.int64)),
                     *(batch.column(5 + k).slice(a, b - a) for k in range(len(carried)))],
                    names=[*DOC, "text", "n_words", "n_removed", *carried])

    out = joined.select(*DOC, "blob", "spans", *carried).mapInArrow(run, schema)
    return out.select(*DOC, "text", "n_words", "n_removed", *(F.col(c).alias(n) for c, n in zip(carried, carry)))


def _rebuilt(words: Words, gone: np.ndarray, layout: bool) -> pa.Array:
    """The texts without the words that are gone."""
    n = len(words.offsets) - 1
    if layout:
        edges, data = words.offsets, words.data
        owner = words.doc_of()[gone]
        after = np.append(words.starts[1:], len(data))[gone] if len(gone) else words.starts
        step = np.zeros(len(data) + 1, np.int8)
        step[words.starts[gone]] += 1
        step[np.minimum(after, words.offsets[owner + 1])] -= 1
        keep = np.cumsum(step[:-1], dtype=np.int8) == 0
    else:
        data, starts, ends = normalized(words)
        keep = np.repeat(~gone, ends - starts + 1)
        left = np.flatnonzero(~gone)
        doc = words.doc_of()[left]
        final = left[np.append(doc[1:] != doc[:-1], True)] if len(left) else left
        keep[ends[final]] = False  # no space after a text's last kept word
        edges = np.append(starts, len(data))[words.first]
    kept = [np.count_nonzero(keep[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    offsets = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)]).astype(np.int64)
    return pa.Array.from_buffers(
        pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data[keep])]
    ).cast(pa.binary()).cast(pa.string())


def restore_id(name: str):
    """The column ``id`` of the results above as it was given."""
    return F.when(F.col("id") != F.lit(_NULL_ID).cast("long"), F.col("id")).alias(name)
