"""Packing of token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import os
import re
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.llm.common import column_of, records, slices, tidied, worker_tables

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def differencing(sizes, windows: int) -> list[list[int]]:
    """Spread items over ``windows`` so that the sums are near equal.

    Multiway differencing: every item starts as a partial partition with one filled
    window. The two partial partitions with the largest imbalance are merged again and
    again, the fullest window of one on the emptiest of the other, until one is left.
    A partial partition keeps its filled windows only, fullest first; the others are
    empty. Ties go to the earlier partial partition, so the result is fixed by the
    sizes. Returns the indices of the items in each window.
    """
    if not len(sizes):
        return [[] for _ in range(windows)]
    # A filled window is one number: its sum, then its node - an item (its index) or a pair of nodes.
    pairs: list[np.ndarray] = []
    n = made = len(sizes)
    heap = [(-int(s), i, np.array([int(s) << 32 | i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = len(a) + len(b) - windows
        if over > 0:
            # The emptiest windows of a meet the emptiest of b in opposite order.
            x, y = a[len(a) - over :], b[len(b) - over :][::-1]
            pairs.append(np.column_stack([x, y]) & 0xFFFFFFFF)
            joined = ((x >> 32) + (y >> 32)) << 32 | np.arange(made, made + over)
            made += over
            both = np.concatenate([a[: len(a) - over], b[: len(b) - over], joined])
        else:
            both = np.concatenate([a, b])
        both.sort()
        both = both[::-1]
        spread = int(both[0] >> 32) - (int(both[-1] >> 32) if len(both) == windows else 0)
        heapq.heappush(heap, (-spread, turn, both))
        turn += 1
    nodes = np.concatenate(pairs).tolist() if pairs else []
    out: list[list[int]] = []
    for top in (heap[0][2] & 0xFFFFFFFF).tolist():
        items, stack = [], [top]
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += nodes[x - n]
        out.append(items)
    return out + [[] for _ in range(windows - len(out))]


def windows_for(sizes, capacity: int) -> list[list[int]]:
    """Near-equal windows none of which exceeds the capacity.

    Starts at the least count the total allows; the count rises while a window is over
    capacity, by one or by a quarter of a hundredth. Every size must be within the capacity.
    """
    total = int(sum(sizes))
    count = max(1, -(-total // capacity)) if len(sizes) else 0
    while count:
        made = differencing(sizes, count)
        if all(sum(sizes[i] for i in w) <= capacity for w in made):
            return [w for w in made if w]
        count += max(1, count // 400)
    return []


def plan_chunk(lengths: list[int], capacity: int, longest_piece: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for one chunk of documents.

    A document's whole windows are cut off as full sequences; what remains is cut into
    pieces of at most ``longest_piece``, small enough to balance, and these are packed
    by differencing.
    """
    pieces, sequence, sizes, parts = [], 0, [], []
    for d, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            pieces.append((d, k * capacity, capacity, sequence, 0))
            sequence += 1
        for start in range(whole * capacity, n, longest_piece):
            parts.append((d, start))
            sizes.append(min(longest_piece, n - start))
    for window in windows_for(sizes, capacity):
        offset = 0
        for i in sorted(window):
            pieces.append((*parts[i], sizes[i], sequence, offset))
            offset += sizes[i]
        sequence += 1
    return pieces


#: Lower-cased text of plain characters only; all are below 256.
PLAIN = re.compile("[\\x00-&(-\\x7e\u00df-\u00f6\u00f8-\u00ff]*")


def _classes() -> np.ndarray:
    """Of each character below 256: 0 white space, 1 letter, 2 any other sign."""
    table = np.full(256, 2, np.uint8)
    for c in range(256):
        if chr(c).isalpha():
            table[c] = 1
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


CLASSES = _classes()


class WordTokens:
    """Token ids of texts, little-endian, through a bounded table of runs.

    White space always ends a token of this tokenizer, and in plain text without
    apostrophes so does the change from letters to other signs and back; it lowers case
    itself. A text's ids are thus those of its runs in turn. Plain texts are joined, cut
    and their runs numbered as one array of bytes, so each run is looked up once a batch and
    the ids gathered at once. What the table lacks goes to the library: runs of letters to
    its model and byte alphabet alone, the others to the whole of it. Other texts are cut at
    spaces and line feeds only and their words taken as they are.
    """

    def __init__(self, path: str, end_id: int, most_runs: int = 300_000, longest: int = 64):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.library.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.end_id = end_id
        self.runs: dict[bytes, np.ndarray] = {}
        self.word_end = np.zeros(self.library.get_vocab_size(), bool)
        self.word_end[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        # A special token's name counts as such only in the text as it is.
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.most_runs, self.longest = most_runs, longest

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_letters(self, runs: list[str]) -> list[bytes]:
        """Ids of runs of letters, as one text: the last token of each is marked as a word's end."""
        ids = np.array(self.letters.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.word_end[ids]) + 1
        if len(ends) != len(runs):
            return self._ids(runs)
        flat, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [flat[a:b] for a, b in zip(at, at[1:])]

    def _known(self, runs: list[bytes]) -> list[bytes]:
        """Ids of distinct runs of plain text; the short ones are kept."""
        if len(self.runs) > self.most_runs:
            for r in list(islice(self.runs, len(self.runs) // 2)):  # the older half
                del self.runs[r]
        known = self.runs
        out = [known.get(r) for r in runs]
        new = [i for i, x in enumerate(out) if x is None]
        words = [runs[i].decode("latin-1") for i in new]
        letters = [k for k, w in enumerate(words) if CLASSES[ord(w[0])] == 1]
        other = [k for k, w in enumerate(words) if CLASSES[ord(w[0])] != 1]
        for group, learn in ((letters, self._of_letters), (other, self._ids)):
            for at in range(0, len(group), 10_000):
                part = group[at : at + 10_000]
                for k, ids in zip(part, learn([words[k] for k in part]), strict=True):
                    out[new[k]] = ids
                    if len(words[k]) <= self.longest:
                        known[runs[new[k]]] = ids
        return out

    def _gather(self, parts: pa.Array, bounds: np.ndarray, ids_of) -> list[np.ndarray]:
        """Ids of each text, the end id last: text i is made of ``parts`` from bounds[i] to bounds[i + 1]."""
        coded = parts.dictionary_encode()
        ids = ids_of(coded.dictionary.to_pylist())
        numbers = coded.indices.to_numpy()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), "<u4")
        own = sizes[numbers]
        before = np.concatenate([[0], np.cumsum(own)])
        flat = flat[np.repeat(first[numbers] - before[:-1], own) + np.arange(before[-1])]
        ends = before[bounds]
        flat = np.insert(flat, ends[1:], np.uint32(self.end_id))
        return np.split(flat, (ends + np.arange(len(ends)))[1:-1])

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of lower-cased plain texts."""
        data = np.frombuffer(" ".join(texts).encode("latin-1"), np.uint8)
        kind = CLASSES[data]
        solid = kind > 0
        begins = solid.copy()
        begins[1:] &= kind[1:] != kind[:-1]
        starts = np.flatnonzero(begins)
        # the runs one after the other, without what is between them
        offsets = np.append(np.cumsum(solid)[starts] - 1, np.count_nonzero(solid)).astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])])
        ends = np.cumsum([len(t) + 1 for t in texts])
        return self._gather(runs, np.concatenate([[0], np.searchsorted(starts, ends)]), self._known)

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of other texts, cut at spaces and line feeds."""
        words = [[w for w in t.replace("\n", " ").split(" ") if w] for t in texts]
        bounds = np.cumsum([0] + [len(w) for w in words])
        return self._gather(pa.array([w for ws in words for w in ws], pa.string()), bounds, self._ids)

    def encode(self, texts: list) -> list[np.ndarray]:
        """Ids of each text (null: empty), the end id last."""
        plain, raw = {}, {}
        for i, t in enumerate(texts):
            low = (t or "").lower()
            if PLAIN.fullmatch(low) and not ("|>" in low and any(x in t for x in self.special)):
                plain[i] = low
            else:
                raw[i] = t
        out: list = [None] * len(texts)
        for group, code in ((plain, self._plain), (raw, self._raw)):
            if group:
                for i, ids in zip(group, code(list(group.values())), strict=True):
                    out[i] = ids
        return out


def loaded(path: str, end_id: int) -> WordTokens:
    """The worker's own tables, kept from task to task."""
    if (__name__, path, end_id) not in worker_tables:
        worker_tables[__name__, path, end_id] = WordTokens(path, end_id)
    return worker_tables[__name__, path, end_id]


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, longest_piece: int = 512, chunk_tokens: int = 2_000_000) -> DataFrame:
    """Cut and pack all documents (doc_id, text) into sequences of at most ``capacity`` ids.

    Works within each partition of the input on runs of documents of about
    ``chunk_tokens`` ids, so it needs no shuffle, a task holds one run, and a lost task
    is redone on its own. sequence_id is made of partition, run and window, hence unique
    but not dense; offsets within a sequence have no gap. A null or empty text is the end
    id alone. Documents with null ids and repeated rows are packed like any other. An
    empty table gives an empty result. Other columns of ``docs`` are ignored.
    """

    @tidied
    def run(batches):
        tokens = loaded(tokenizer, end_id)
        part, made = TaskContext.get().partitionId(), 0
        ids: list = []
        coded: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal made, ids, coded, size
            lengths = [len(c) for c in coded]
            rows = plan_chunk(lengths, capacity, longest_piece)
            base = part << 40 | made << 24
            out = records(
                [
                    [ids[d] for d, *_ in rows],
                    [r[1] for r in rows],
                    [r[2] for r in rows],
                    [zlib.crc32(coded[d][s : s + n]) for d, s, n, _, _ in rows],
                    [lengths[d] for d, *_ in rows],
                    [base + r[3] for r in rows],
                    [r[4] for r in rows],
                ],
                SCHEMA,
            )
            made, ids, coded, size = made + 1, [], [], 0
            return out

        for batch in batches:
            for rows, texts in slices(batch, "text", 4_000_000):
                for doc_id, c in zip(column_of(rows, "doc_id").to_pylist(), tokens.encode(texts), strict=True):
                    ids.append(doc_id)
                    coded.append(c)
                    size += len(c)
                    if size >= chunk_tokens:  # about 8 MB of ids
                        yield flush()
        if ids:
            yield flush()

    schema = T.StructType([T.StructField(f.name, T.LongType()) for f in SCHEMA])
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, schema)
