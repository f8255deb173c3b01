"""SentencePiece BPE by a table of each prefix's last token."""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import column_of, records, slices, tidied

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
META = "▁"


def make_room(table: dict, most: int) -> None:
    """Take the older half out of a table that holds more than ``most`` entries."""
    if len(table) > most:
        for key in list(islice(table, len(table) // 2)):
            del table[key]


class PrefixTable:
    """Encodes and decodes as the library does, from the model's pieces and scores alone.

    Merging always takes the best-scored adjacent pair, leftmost first, so the encoding
    of a text is right exactly if every two neighbouring tokens are right by themselves;
    hence every prefix has one last token. An automaton gives the pieces that end at a
    position; the one that is compatible with the last token of the prefix before it is
    stored, and the ids are read from the end backwards.

    A text is cut wherever no piece holds the two characters on both sides, since no merge
    crosses such a place. The places are found for a whole batch at once, on its bytes: a
    pair of bytes that ends one character and begins the next is one table lookup. The runs
    between them are numbered, so each is looked up once a batch, and kept with their ids
    and their decoded form in a table of bounded size.
    """

    def __init__(self, path: str, most_runs: int = 250_000, most_pairs: int = 300_000, longest: int = 64):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        lib = self.library = SentencePieceProcessor(model_file=path)
        count = lib.get_piece_size()
        plain = [i for i in range(count) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.piece_id = {lib.id_to_piece(i).replace(META, " "): i for i in plain}
        self.score = {lib.id_to_piece(i).replace(META, " "): lib.get_score(i) for i in plain}
        self.byte_id = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(count) if lib.is_byte(i)}
        names = [lib.id_to_piece(i) for i in range(count)]
        self.surface = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace(META, " ").encode() for i, p in enumerate(names)]
        self.digits = [b"%d " % i for i in range(count)]
        self.end_id, self.unknown = lib.eos_id(), lib.unk_id()
        joined = [p for p in self.piece_id if len(p) > 1]
        self.inner = {c for p in joined for c in p}
        # no_cut[a, b]: byte a may be followed by byte b within a piece
        self.no_cut = np.zeros((256, 256), bool)
        self.no_cut[:, 0x80:0xC0] = True  # inside a character
        for p in joined:
            for x, y in zip(p, p[1:]):
                self.no_cut[x.encode()[-1], y.encode()[0]] = True
        self.automaton = ahocorasick.Automaton()
        for p in {*self.piece_id, *self.inner}:
            self.automaton.add_word(p, (len(p), p))
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.runs: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.most_runs, self.most_pairs, self.longest = most_runs, most_pairs, longest

    def merged(self, text: str) -> list[str]:
        """The merges done one by one on a short text; decides compatibility only."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                s = self.score.get(symbols[k] + symbols[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def compatible(self, before: str, token: str) -> bool:
        """Whether ``before`` and ``token`` stay as they are side by side; kept for the next time."""
        ok = self.fits[before, token] = self.merged(before + token) == ([before, token] if before else [token])
        return ok

    def tokens(self, run: str) -> list[str]:
        """The tokens of a run whose characters the automaton knows all."""
        last: list = [None] * (len(run) + 1)
        last[0] = ""
        known = self.fits.get
        for end, (size, token) in self.automaton.iter(run):
            end += 1
            before = last[end - size]
            if before is not None and last[end] is None:
                ok = known((before, token))
                if ok or ok is None and self.compatible(before, token):
                    last[end] = token
        out, at = [], len(run)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def ids(self, run: str) -> list[int]:
        """Ids of any text; characters outside all longer pieces stand alone."""
        parts: list[str] = []
        if self.inner.issuperset(run):
            parts = self.tokens(run)
        else:
            start = 0
            for k, c in enumerate(run):
                if c not in self.inner:
                    parts += self.tokens(run[start:k])
                    parts.append(c)
                    start = k + 1
            parts += self.tokens(run[start:])
        try:
            return [self.piece_id[t] for t in parts]
        except KeyError:
            return [i for t in parts for i in self._one(t)]

    def _one(self, token: str) -> list[int]:
        i = self.piece_id.get(token)
        if i is not None:
            return [i]
        return [self.byte_id[b] for b in token.encode("utf-8")] if self.byte_id else [self.unknown]

    def decoded(self, ids: list[int]) -> bytes:
        """The bytes that the ids stand for, word marks as spaces."""
        return b"".join([self.surface[i] for i in ids])

    def _run(self, run: bytes) -> tuple[int, bytes, bytes]:
        ids = self.ids(run.decode("utf-8", "surrogatepass"))
        return len(ids), b"".join([self.digits[i] for i in ids]), self.decoded(ids)

    def encode(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """For each text the number of ids, the ids as decimal text, the decoded bytes.

        The end id counts and ends the ids. The library gives the normal form of a text; the
        rest is done here. It drops the space that the normal form puts first.
        """
        whole = [self.library.normalize(t).replace(META, " ").encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        ends = np.cumsum([0] + [len(w) for w in whole])
        data = np.frombuffer(b"".join(whole), np.uint8)
        cut = np.ones(len(data) + 1, bool)
        if len(data):
            cut[1:-1] = ~self.no_cut[data[:-1], data[1:]]
        cut[ends] = True
        places = np.flatnonzero(cut)
        bounds = np.searchsorted(places, ends)
        coded = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        make_room(self.runs, self.most_runs)
        make_room(self.fits, self.most_pairs)
        known, made = self.runs, []
        for run in coded.dictionary.to_pylist():
            found = known.get(run)
            if found is None:
                found = self._run(run)
                if len(run) <= self.longest:
                    known[run] = found
            made.append(found)
        numbers = coded.indices
        before = np.concatenate([[0], np.cumsum(np.array([m[0] for m in made], np.int64)[numbers.to_numpy()])]) if made else np.zeros(1, np.int64)
        ids, decoded = (pa.array([m[k] for m in made], pa.large_binary()).take(numbers) for k in (1, 2))
        id_at, decoded_at = (np.frombuffer(x.buffers()[1], np.int64)[: len(x) + 1] for x in (ids, decoded))
        id_bytes, decoded_bytes = (memoryview(x.buffers()[2] or b"") for x in (ids, decoded))
        last, out = b"%d" % self.end_id, []
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            text = bytes(decoded_bytes[decoded_at[a] : decoded_at[b]])
            out.append((int(before[b] - before[a]) + 1, bytes(id_bytes[id_at[a] : id_at[b]]) + last, text[1:] if text[:1] == b" " else text))
        return out


_loaded: dict[str, PrefixTable] = {}


def loaded(path: str) -> PrefixTable:
    if path not in _loaded:
        _loaded[path] = PrefixTable(path)
    return _loaded[path]


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """Number and SHA-256 digests of the ids and of the decoded text of each document.

    One row per row of ``docs`` (doc_id, text), repeated rows and null ids included;
    null and empty texts are the end id alone. Other columns are ignored. No shuffle;
    a worker holds one batch of rows and the bounded tables.
    """

    @tidied
    def run(batches):
        table = loaded(model)
        for batch in batches:
            for rows, texts in slices(batch, "text", 4_000_000):
                made = table.encode([t or "" for t in texts])
                yield records(
                    [
                        column_of(rows, "doc_id"),
                        [m[0] for m in made],
                        [hashlib.sha256(m[1]).hexdigest() for m in made],
                        [hashlib.sha256(m[2].decode("utf-8", "replace").encode()).hexdigest() for m in made],
                    ],
                    SCHEMA,
                )

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
