"""Substring dedup: suffix automata of reference shards, matching statistics, removal of maximal repeated spans."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.llm.common import U64, bound_batches, flat, gram_hashes, pieces, release, word_bounds, word_hashes

#: Words of the shortest span that is removed.
SPAN = 13
#: Words of the sub-runs whose least hash names a window: any two equal windows have the same name.
ANCHOR = 6
#: Bytes of text that one task holds at a time; a longer document is a bucket of its own size.
BUCKET_BYTES = 8 << 20
#: Words of reference passages that one automaton holds.
SHARD_WORDS = 100_000
_NO_ID = np.iinfo(np.int64).max


# --- suffix automata ---------------------------------------------------------------------------


class SuffixAutomaton:
    """All substrings of a set of word sequences. Each state stands for substrings that end at the same places.

    ``first[state]`` is the least document of the window of SPAN words that the state stands for, where one is known.
    """

    def __init__(self, span: int = SPAN):
        self.span = span
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.first: dict[int, int] = {}

    def _split(self, parent: int, word: int, old: int) -> int:
        """A state for the short part of ``old``, reached from ``parent``."""
        new = len(self.next)
        self.next.append(self.next[old].copy())
        self.link.append(self.link[old])
        self.length.append(self.length[parent] + 1)
        self.link[old] = new
        at = parent
        while at != -1 and self.next[at].get(word) == old:
            self.next[at][word] = new
            at = self.link[at]
        return new

    def add(self, words: Sequence[int]) -> None:
        following, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            known = following[last].get(word)
            if known is not None:
                last = known if length[known] == length[last] + 1 else self._split(last, word, known)
                continue
            new = len(following)
            following.append({})
            link.append(0)
            length.append(length[last] + 1)
            at = last
            while at != -1 and word not in following[at]:
                following[at][word] = new
                at = link[at]
            if at != -1:
                known = following[at][word]
                link[new] = known if length[known] == length[at] + 1 else self._split(at, word, known)
            last = new

    def matches(self, words: Sequence[int]) -> Iterable[tuple[int, int]]:
        """(position, state) wherever at least ``span`` words that end there match; the state is that of the last ``span`` words."""
        following, link, length, span = self.next, self.link, self.length, self.span
        state = size = 0
        for i, word in enumerate(words):
            to = following[state].get(word)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = following[state].get(word)
            if to is None:
                size = 0
                continue
            state = to
            size += 1
            while length[link[state]] >= span:
                state = link[state]
            if size > length[state]:
                size = length[state]
            if size >= span:
                yield i, state

    def note(self, words: Sequence[int], doc: int) -> list[int]:
        """``doc`` holds these words: keep the least document of each of their windows, and return the windows' states."""
        first = self.first
        states = [state for _, state in self.matches(words)]
        for state in states:
            if doc < first.get(state, _NO_ID + 1):
                first[state] = doc
        return states


def covered(ends: Iterable[int], n_words: int) -> np.ndarray:
    """Which words lie in a window that ends at one of the positions."""
    at = np.unique(np.fromiter(ends, np.int64))
    marks = np.zeros(n_words + 1, np.int64)
    np.add.at(marks, at - SPAN + 1, 1)
    np.add.at(marks, at + 1, -1)
    return np.cumsum(marks[:-1]) > 0


# --- windows of a bucket -----------------------------------------------------------------------


class _Bucket:
    """Words and windows of the documents of one bucket, and its passages: runs of windows with one name."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("doc_id").cast(pa.int64()).fill_null(_NO_ID).to_numpy()
        self.data, self.offsets = flat(table.column("text"))
        hashes, starts, ends, firsts, base = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], 0
        for a, b in pieces(self.offsets):
            data, offsets = self.data[self.offsets[a] : self.offsets[b]], self.offsets[a : b + 1] - self.offsets[a]
            s, e, first = word_bounds(data, offsets)
            hashes.append(gram_hashes(word_hashes(data, s, e), ANCHOR))
            hashes.append(np.zeros(len(s) - len(hashes[-1]), U64))  # as many as words; no window holds the last ones
            starts.append(s + self.offsets[a])
            ends.append(e + self.offsets[a])
            firsts.append(first[1:] + base)
            base += len(s)
        self.starts, self.ends, self.first = np.concatenate(starts), np.concatenate(ends), np.concatenate(firsts)
        lengths = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        n = max(0, base - SPAN + 1)
        #: windows inside one document, by their first word
        self.valid = np.flatnonzero(self.doc[:n] == self.doc[SPAN - 1 :][:n])
        least = np.concatenate(hashes)
        width, want = 1, SPAN - ANCHOR + 1
        while width < want and len(least):
            step = min(width, want - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        names = least[self.valid] if len(self.valid) else np.zeros(0, U64)
        new = np.ones(len(names), bool)
        new[1:] = (names[1:] != names[:-1]) | (np.diff(self.valid) != 1) | (self.doc[self.valid[1:]] != self.doc[self.valid[:-1]])
        runs = np.flatnonzero(new)
        #: of each passage: its name, document, first word and number of windows
        self.names, self.at, self.windows = names[runs], self.valid[runs], np.diff(np.append(runs, len(names)))
        self.owner = self.doc[self.at] if len(runs) else np.zeros(0, np.int64)

    def words(self) -> tuple[bytes, np.ndarray]:
        """All words with one space after each, and where each begins."""
        sizes = self.ends - self.starts
        begin = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes + 1, out=begin[1:])
        out = np.full(int(begin[-1]), 32, np.uint8)
        step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(begin[:-1], sizes) + step] = self.data[np.repeat(self.starts, sizes) + step]
        return out.tobytes(), begin

    def passages(self, shared: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(index, words joined by one space) of the passages whose names are in the sorted array."""
        if not len(shared) or not len(self.names):
            return
        found = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, self.names), len(shared) - 1)] == self.names)
        raw, begin = self.words()
        last = self.at[found] + self.windows[found] + SPAN - 1
        for i, a, b in zip(found.tolist(), begin[self.at[found]].tolist(), begin[last].tolist(), strict=True):
            yield i, raw[a : b - 1]


def _shards(passages: list[list[bytes]], names: Sequence[int], most: int) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """Passages (index, first window, words) in runs for one automaton each; passages of one name stay together.

    A name with more than ``most`` words is cut into single windows, which are dealt by their first two words: equal
    windows still meet.
    """
    held: list[tuple[int, int, list[bytes]]] = []
    size, at = 0, 0
    while at < len(passages):
        end = at
        while end < len(passages) and names[end] == names[at]:
            end += 1
        words = sum(len(p) for p in passages[at:end])
        if words > most:
            parts: list[list[tuple[int, int, list[bytes]]]] = [[] for _ in range(math.ceil(words * SPAN / most))]
            for i in range(at, end):
                for k in range(len(passages[i]) - SPAN + 1):
                    window = passages[i][k : k + SPAN]
                    parts[xxhash.xxh3_64_intdigest(b" ".join(window[:2])) % len(parts)].append((i, k, window))
            yield from (p for p in parts if p)
        else:
            if size + words > most and held:
                yield held
                held, size = [], 0
            held += [(i, 0, passages[i]) for i in range(at, end)]
            size += words
        at = end
    if held:
        yield held


def first_documents(passages: list[list[bytes]], names: Sequence[int], docs: Sequence[int], most: int = SHARD_WORDS) -> list[list[int]]:
    """For each passage (words; ``docs``: its least document) the least document of each of its windows, over all passages.

    Every run of passages is one suffix automaton. Streaming the passages through it gives the states of their windows, which
    collect the least document.
    """
    out: list[list[int]] = [[_NO_ID] * (len(p) - SPAN + 1) for p in passages]
    for shard in _shards(passages, names, most):
        code: dict[bytes, int] = {}
        automaton = SuffixAutomaton()
        coded = [[code.setdefault(w, len(code)) for w in words] for *_, words in shard]
        for words in coded:
            automaton.add(words)
        found = [automaton.note(words, docs[i]) for (i, _, _), words in zip(shard, coded, strict=True)]
        first = automaton.first
        for (i, k, _), states in zip(shard, found, strict=True):
            # the words of a passage are in its automaton: every window matches, in order
            out[i][k : k + len(states)] = [first[state] for state in states]
    return out


_NAMES = "name long, place long"
_PASSAGES = "name long, bucket long, passage binary, low long, high long"
_FIRSTS = "name long, key binary, firsts binary, buckets array<long>"


def deduplicate_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, keep_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and, with ``keep_text``, kept_text.

    Removes every word that lies in a window of SPAN words whose word sequence also starts in a document of a smaller id,
    judged on the input. Ids are integers. A null id counts as larger than any, and never as the first place; rows that
    repeat an id don't take words from each other; null and empty texts have no words. Other columns are not read; an
    empty table gives no rows.

    Documents are dealt to buckets of bounded size. 1. Names (least hash of a window's sub-runs) that more than one
    document holds are candidates; names are a fifth of the windows. 2. The passages (runs of windows with one such name)
    of each bucket go, each distinct one once, to the shard of their name. A shard builds suffix automata of its
    reference passages and streams the passages through them: matching statistics over the words themselves give each
    window's first document. 3. The answers return to the buckets by the passages' 128-bit keys. A passage that stands
    everywhere has one entry for each bucket, eight bytes for BUCKET_BYTES of text.
    """
    bound_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    out = T.StructType([picked.schema["doc_id"], *(T.StructField(n, k) for n, k in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("kept_text", T.StringType())))])
    out = out if keep_text else T.StructType(out.fields[:-1])
    blank = F.coalesce(F.col("text"), F.lit("")) == ""
    texts = picked.where(~blank).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("long"))
    held = texts.groupBy("bucket")

    def bucket_names(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = _Bucket(table)
        doc = bucket.ids[bucket.owner]
        order = np.argsort(bucket.names, kind="stable")
        names, doc = bucket.names[order], doc[order]
        starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
        low, high = (np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)) if len(starts) else (doc, doc)
        release()
        # the bucket, and in the last bit whether several of its documents hold the name
        return pa.table([pa.array(names[starts].view(np.int64)), pa.array(2 * keys[0].as_py() + (low != high).astype(np.int64))], names=["name", "place"])

    def bucket_passages(keys: tuple[pa.Scalar, ...], table: pa.Table, reply: pa.Table) -> pa.Table:
        bucket, number = _Bucket(table), keys[0].as_py()
        ids, names = bucket.ids[bucket.owner].tolist(), bucket.names.view(np.int64).tolist()
        found: dict[bytes, list[int]] = {}
        for i, passage in bucket.passages(np.sort(reply.column("name").to_numpy().view(U64))):
            entry = found.get(passage)
            if entry is None:
                found[passage] = [names[i], ids[i], ids[i]]
            else:
                entry[1], entry[2] = min(entry[1], ids[i]), max(entry[2], ids[i])
        columns = [[e[0] for e in found.values()], [number] * len(found), list(found), [e[1] for e in found.values()], [e[2] for e in found.values()]]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        out = pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["name", "bucket", "passage", "low", "high"])
        del found, columns, bucket
        release()
        return out

    def shard_firsts(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("name")
        texts = table.column("passage").to_pylist()
        words = [p.split(b" ") for p in texts]
        low, high = table.column("low").to_pylist(), table.column("high").to_pylist()
        firsts = first_documents(words, table.column("name").to_pylist(), low, shard_words)
        # a passage that one document holds alone, and all of whose windows start there, has nothing to lose
        told = [i for i, f in enumerate(firsts) if low[i] != high[i] or min(f) < low[i]]
        rows = pa.array(told, pa.int64())
        # one number where all windows start in one document
        told_firsts = pa.array([np.array(f if min(f) != max(f) else f[:1], np.int64).tobytes() for f in map(firsts.__getitem__, told)], pa.binary())
        told_keys = pa.array([xxhash.xxh3_128_digest(texts[i]) for i in told], pa.binary())
        out = pa.table([table.column("name").take(rows), told_keys, told_firsts, table.column("buckets").take(rows).cast(pa.list_(pa.int64()))], names=["name", "key", "firsts", "buckets"])
        del texts, words, firsts
        release()
        return out

    def removed(keys: tuple[pa.Scalar, ...], table: pa.Table, reply: pa.Table) -> pa.Table:
        bucket = _Bucket(table)
        gone: dict[int, list[np.ndarray]] = {}
        owner, windows, at, first, ids = (x.tolist() for x in (bucket.owner, bucket.windows, bucket.at, bucket.first, bucket.ids))
        if reply.num_rows:
            answers = dict(zip(reply.column("key").to_pylist(), reply.column("firsts").to_pylist(), strict=True))
            for i, passage in bucket.passages(np.sort(np.unique(reply.column("name").to_numpy()).view(U64))):
                answer = answers.get(xxhash.xxh3_128_digest(passage))
                if answer is not None:
                    d = owner[i]
                    if len(answer) == 8:
                        hit = np.arange(windows[i]) if int.from_bytes(answer, "little", signed=True) < ids[d] else ()
                    else:
                        hit = np.flatnonzero(np.frombuffer(answer, np.int64) < ids[d])
                    if len(hit):
                        gone.setdefault(d, []).append(hit + (at[i] - first[d] + SPAN - 1))
        n_removed, digests, texts_kept = [], [], []
        for d in range(table.num_rows):
            words = bucket.data[bucket.offsets[d] : bucket.offsets[d + 1]].tobytes().split()
            drop = covered(np.concatenate(gone[d]), len(words)) if d in gone else None
            if drop is not None:
                words = [w for w, g in zip(words, drop.tolist(), strict=True) if not g]
            kept = b" ".join(words)
            n_removed.append(0 if drop is None else int(drop.sum()))
            digests.append(hashlib.sha256(kept).hexdigest())
            if keep_text:
                texts_kept.append(kept.decode())
        columns = [table.column("doc_id"), pa.array(np.diff(bucket.first), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts_kept, pa.string())]
        release()
        return pa.table(columns[: len(out.names)], names=out.names)

    by_name = Window.partitionBy("name")
    names = held.applyInArrow(bucket_names, _NAMES)
    repeated = (F.count(F.lit(1)).over(by_name) > 1) | (F.col("place") % 2 == 1)
    shared = names.withColumn("_many", repeated).where("_many").select((F.shiftright("place", 1)).alias("bucket"), "name")
    passages = held.cogroup(shared.groupBy("bucket")).applyInArrow(bucket_passages, _PASSAGES)
    # a name is a hash already: its shard needs no other
    dealt = passages.withColumn("shard", F.pmod("name", F.lit(buckets))).repartition("shard")
    distinct = dealt.groupBy("shard", "name", "passage").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("bucket").alias("buckets"))
    firsts = distinct.groupBy("shard").applyInArrow(shard_firsts, _FIRSTS)
    replies = firsts.select("name", "key", "firsts", F.explode("buckets").alias("bucket"))
    done = held.cogroup(replies.groupBy("bucket")).applyInArrow(removed, out)
    nothing = [F.col("doc_id"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit("").alias("kept_text")]
    return done.unionByName(picked.where(blank).select(*nothing[: len(out.names)]))
