"""SentencePiece encoding and decoding by a batched numpy Viterbi over a public vocabulary.

A text becomes words: a space is written ``▁``, one stands before the text, words are cut before runs of ``▁`` and around
newlines (no piece crosses these). All distinct words of one length advance together: hashes of all substrings up to the
longest piece probe the sorted piece keys, and at each position the vectorised maximum over piece lengths gives the
best score and its back pointer (of equal scores the longest piece). A character that no piece holds becomes its UTF-8
bytes. Decoding gives exactly the text back, also where it holds ``▁`` itself, which is written in bytes.

With log probabilities for scores the path with the best sum wins. A vocabulary made by merges has ranks instead: its
scores say which merge comes first, and their sums mean nothing. A path then scores 0 if merging leaves each two neighbours
of it apart, and minus infinity otherwise. Exactly one path to each position scores 0: merges on either side of a
boundary that none crosses do not depend on each other, so these are the ids that the library's merges give.

Null and empty texts have no ids. Words of any length are encoded whole: long ones in parts of ``PART`` characters, with
what the parts need of each other. Repeated rows are encoded alike, an empty table gives an empty table, and other columns stay
whatever their names, but ``out`` and ``check``, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_files import runs

SPACE, STAND_IN = "▁", "\udfff"
#: Characters of a word that are looked up at once.
PART = 1 << 16
#: Bits of a hash that find a place: among the marks of piece keys, among pairs of pieces met lately.
MARKS, LATELY = 18, 20
WORDS = re.compile("▁*[^▁\n]+|▁+|\n")
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def _codes(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length: words x length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)


def _substring_hashes(codes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hashes of all substrings of that length by their start) from rolling prefix hashes."""
    n, length = codes.shape
    letters = _mix(codes.astype(U) + U(1))
    prefix = np.zeros((n, length + 1), U)
    for i in range(length):
        prefix[:, i + 1] = prefix[:, i] * BASE + letters[:, i]
    powers = np.cumprod(np.full(max(1, min(longest, length)), BASE, U), dtype=U)
    for k in range(1, min(longest, length) + 1):
        power = powers[k - 1]
        yield k, _mix(prefix[:, k:] - prefix[:, :-k] * power + U(k))


class Vocabulary:
    """Pieces, their scores and sorted keys, read from a model file; keeps a bounded memory of encoded words."""

    def __init__(self, path: str, known: int = 250_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.text = {i: model.id_to_piece(i) for i in plain}
        raw = np.array([model.get_score(i) for i in plain])
        #: rank of each piece where the vocabulary was made by merges, else None
        self.rank = dict(zip(self.text.values(), (-raw).tolist(), strict=True)) if len(raw) and np.all(raw == np.round(raw)) else None
        self.stable: dict[int, bool] = {}
        #: at the place that its hash names: the pair met last, doubled, and whether it is stable
        self.lately = np.full(1 << LATELY, -1, np.int64)
        scores = raw
        self.byte_id = {b: model.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.longest = max(map(len, self.text.values()))
        #: by piece length: sorted keys, and ids and scores in their order
        self.probes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        #: by piece length: whether a key begins with these bits; most substrings are no piece and need no search
        self.marks: dict[int, np.ndarray] = {}
        for length in {len(t) for t in self.text.values()}:
            at = np.array([j for j, i in enumerate(plain) if len(self.text[i]) == length])
            *_, (_, h) = _substring_hashes(_codes([self.text[plain[j]] for j in at], length), length)
            order = np.argsort(h[:, 0])
            self.probes[length] = h[order, 0], np.array(plain, np.int32)[at[order]], scores[at[order]]
            self.marks[length] = np.zeros(1 << MARKS, bool)
            self.marks[length][h[:, 0] >> U(64 - MARKS)] = True
            if len(np.unique(h)) != len(h):
                raise ValueError("two pieces share a key")
        self.unknown = float(scores.min()) - 10.0
        size = model.vocab_size()
        self.bytes: list[bytes] = [b""] * size
        for i, t in self.text.items():
            self.bytes[i] = t.replace(SPACE, " ").encode()
        for b, i in self.byte_id.items():
            self.bytes[i] = bytes([b])
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.known = known
        #: words met lately, and those before them; each half of what is known
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """What merging makes of a text: the pair whose piece has the lowest rank first, of equal ones the leftmost."""
        parts, rank = list(text), self.rank.get
        ranks = [rank(x + y, np.inf) for x, y in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < np.inf:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            for i in range(max(0, at - 1), min(at + 1, len(ranks))):
                ranks[i] = rank(parts[i] + parts[i + 1], np.inf)
        return parts

    def _apart(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether merging leaves the pieces (-1: a character without one, -2: the word's begin) apart and whole."""
        keys = (before.astype(np.int64) + 2) * (len(self.bytes) + 2) + piece + 2
        place = (keys.astype(U) * BASE >> U(64 - LATELY)).astype(np.int64)
        met = self.lately[place]
        found = (met & 1).astype(bool)
        new = np.flatnonzero(met >> 1 != keys)
        if new.size:
            found[new] = self._stable(keys[new])
            self.lately[place[new]] = 2 * keys[new] + found[new]
        return found

    def _stable(self, pairs: np.ndarray) -> np.ndarray:
        size = len(self.bytes) + 2
        keys, where = np.unique(pairs, return_inverse=True)
        known, found = self.stable, np.empty(len(keys), bool)
        for i, key in enumerate(keys.tolist()):
            if (ok := known.get(key)) is None:
                a, b = key // size - 2, key % size - 2
                if b == -1 or a == -1:  # nothing merges with such a character
                    ok = b == -1 or self.merged(self.text[b]) == [self.text[b]]
                else:
                    both = [self.text[x] for x in (a, b) if x >= 0]
                    ok = self.merged("".join(both)) == both
                known[key] = ok
            found[i] = ok
        return found[where]

    def _tables(self, codes: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the piece of each length at each start; axis 0: lengths, longest first."""
        n, length = codes.shape
        score = np.full((top, n, length), -np.inf)
        piece = np.full((top, n, length), -1, np.int32)
        for k, h in _substring_hashes(codes, top):
            if k == 1:
                score[top - 1] = self.unknown
            if k not in self.probes:
                continue
            keys, ids, scores = self.probes[k]
            row, start = np.nonzero(self.marks[k][h >> U(64 - MARKS)])
            probe = h[row, start]
            at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
            same = keys[at] == probe
            at, row, start = at[same], row[same], start[same]
            score[top - k, row, start] = scores[at]
            piece[top - k, row, start] = ids[at]
        return score, piece

    def viterbi(self, words: list[str]) -> list[np.ndarray]:
        """Best piece ids of words that all have the same length."""
        flat, ends = self._paths(words)
        return np.split(flat, ends[:-1])

    def _paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and where each word's end."""
        length = len(words[0])
        codes = _codes(words, length)
        n, top = len(words), min(self.longest, length)
        rows = np.arange(n)
        back = np.zeros((n, length + 1), np.int16)
        last = np.full((n, length + 1), -2, np.int32)  # the piece that ends at each position
        best = np.full((n, length + 1), -np.inf) if self.rank is None else None
        for begin in range(0, length, PART):
            low, end = max(0, begin - top + 1), min(length, begin + PART)
            score, piece = self._tables(codes[:, low:end], top)
            there = score > -np.inf
            for j in range(begin + 1, end + 1):
                if best is not None:
                    best[:, 0] = 0
                    ks = np.arange(min(top, j), 0, -1)
                    paths = best[:, j - ks] + score[top - ks, :, j - ks - low].T
                    first = np.argmax(paths, axis=1)  # the first maximum is the longest piece
                    best[:, j], back[:, j] = paths[rows, first], ks[first]
                    last[:, j] = piece[top - ks[first], rows, j - ks[first] - low]
                    continue
                ks = np.arange(min(top, j), 0, -1)
                open_ = there[top - ks, :, j - ks - low].T
                left = rows
                while left.size:  # one path scores 0: the longest open piece is tried, then the next one
                    first = open_[left].argmax(axis=1)
                    if not open_[left, first].all():
                        raise RuntimeError("no path through a word")
                    k = ks[first]
                    ids = piece[top - k, left, j - k - low]
                    ok = self._apart(last[left, j - k], ids)
                    on = left[ok]
                    back[on, j], last[on, j] = k[ok], ids[ok]
                    left, first = left[~ok], first[~ok]
                    open_[left, first] = False
        # all words walk back together; ids fill from the right
        taken = np.full((n, length), -2, np.int32)
        place, column = np.full(n, length), length
        while (live := np.flatnonzero(place)).size:
            column -= 1
            taken[live, column] = last[live, place[live]]
            place[live] -= back[live, place[live]]
        used = taken != -2
        flat, ends = taken[used], np.cumsum(used.sum(axis=1))
        if (flat == -1).any():
            found = [self._with_bytes(w, ids) for w, ids in zip(words, np.split(flat, ends[:-1]), strict=True)]
            flat, ends = np.concatenate(found), np.cumsum([len(ids) for ids in found])
        return flat, ends

    def _with_bytes(self, word: str, ids: np.ndarray) -> np.ndarray:
        """Write the characters that no piece holds (-1) as bytes."""
        out: list[int] = []
        at = 0
        for i in ids.tolist():
            if i == -1:
                out += [self.byte_id[b] for b in (SPACE if word[at] == STAND_IN else word[at]).encode()]
            else:
                out.append(i)
            at += 1 if i == -1 else len(self.text[i])
        return np.array(out, np.int32)

    def _learn(self, words: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            step = max(1, (1 << 18) // (length * min(length, self.longest)))
            for at in range(0, len(group), step):
                part = group[at : at + step]
                flat, ends = self._paths(part)
                plain = "".join(part).replace(SPACE, " ").replace(STAND_IN, SPACE).encode()
                if self._plain(flat) != plain:
                    raise RuntimeError(f"a substring hash collided in words of {length} characters")
                ids, cuts = flat.tobytes(), [0, *(flat.itemsize * ends).tolist()]
                self.words.update(zip(part, map(ids.__getitem__, map(slice, cuts, cuts[1:])), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [WORDS.findall(SPACE + t.replace(SPACE, STAND_IN).replace(" ", SPACE)) if t else [] for t in texts]
        if 2 * len(self.words) > self.known:
            self.older, self.words = self.words, {}
        missing = {w for words in split for w in words} - self.words.keys()
        again = missing & self.older.keys()
        self.words.update((w, self.older[w]) for w in again)
        self._learn(list(missing - again))
        return [np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int32) for words in split]

    def _plain(self, ids: np.ndarray) -> bytes:
        """The bytes of ids one after another."""
        out = []
        for a in range(0, len(ids), 1 << 20):
            part = ids[a : a + (1 << 20)]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            out.append(self.flat[np.repeat(self.begins[part] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(out)

    def same(self, coded: list[np.ndarray], texts: list[str]) -> list[bool]:
        """Whether each text's ids decode to it."""
        ids = np.concatenate([*coded, np.zeros(0, np.int32)])
        plain = self._plain(ids)
        sizes = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        ends = sizes[np.cumsum([0, *map(len, coded)])].tolist()
        return [plain[a:b] == (b" " + t.encode() if t else b"") for a, b, t in zip(ends, ends[1:], texts, strict=False)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]


#: Vocabularies of this worker process by file, with the words that they remember.
_loaded: dict[str, Vocabulary] = {}


def vocabulary(model: str) -> Vocabulary:
    if model not in _loaded:
        _loaded.clear()
        _loaded[model] = Vocabulary(model)
    return _loaded[model]


def encode(docs: DataFrame, model: str, text: str = "text", out: str = "ids", check: str | None = None) -> DataFrame:
    """``docs`` with ``out ARRAY<INT>``, added or replaced. ``model`` is a file that every executor has.

    ``check`` names a boolean column for whether the ids decode to the text, found in the same pass.
    """
    keep = [c for c in docs.columns if c not in (out, check)]
    source = docs.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index(text)
    made = [f"`{out}` array<int>", *([f"`{check}` boolean"] if check else [])]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields], *made])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(model)
        for batch in batches:
            for begin, texts in runs(batch.column(at), 2 << 20):
                part = batch.slice(begin, len(texts))
                coded = known.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(coded) if coded else np.zeros(0, np.int32)))
                columns, names = [*part.columns, lists], [*keep, out]
                if check:
                    columns, names = [*columns, pa.array(known.same(coded, texts), pa.bool_())], [*names, check]
                yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, schema)


def decode(coded: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``coded`` with the text of its ids as ``out``, added or replaced; null ids give ``''``."""
    keep = [c for c in coded.columns if c != out]
    source = coded.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index(ids)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields], f"`{out}` string"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(model)
        for batch in batches:
            texts = [known.decode(x.values.to_numpy().tolist()) if x.is_valid else "" for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*keep, out])

    return source.mapInArrow(run, schema)
