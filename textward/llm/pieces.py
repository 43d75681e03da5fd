"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into three machines:

* normaliser: one dummy space before the text if the model asks for it, every space becomes U+2581 (a model with
  another character map is refused);
* pieces: an acceptor of the pieces' spellings that emits their ids, as a table by the spellings' numbers;
* byte fallback: a character that is no piece emits its UTF-8 bytes' pieces, or the unknown id.

``arcs`` composes normalised words with the pieces and the byte fallback: lattices of arcs (begin, end, label).
``paths`` has the shortest path through each in the tropical semiring: an arc's sum is its begin's least sum plus its
weight, and of the arcs into a state the least sum stays. Words go through it together, position by position.

What an arc weighs depends on the kind of model. In a unigram model it is the piece's negated score. In a model of
merges scores are ranks, a sum of which would choose other paths than the model does; there an arc weighs 0 if its
piece may follow the last piece of the state it leaves, and infinity if not: two pieces may stand together if merging
the characters of both by the model's ranks ends with just these two. A sequence is the model's own exactly when that
holds for all its neighbours, so every begin of a word has one path of finite weight, a state of finite sum is known
by its position, and the path of least weight is the library's encoding.

Spaces join only what follows them, so the path of a text is the paths of its words, joined. A batch's words are cut
and numbered by Arrow, each distinct one takes one path, and the ids are gathered by number.

Defined cases: null and empty texts have no tokens; decode gives the normalised text back, without the dummy space;
unpaired surrogates can't occur in Arrow text; repeated rows are encoded row by row.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from textward.llm.common import bound_batches, texts, trim

SPACE = "▁"
INFINITE = float("inf")
#: A state of this number or more is a character outside the pieces.
OUTSIDE = 1 << 23
#: Words from which length on take their paths alone.
LONG = 100
#: Words whose paths are searched together, and what stands between them: a character of no piece.
TOGETHER, APART = 25_000, "\x00"
#: Words whose ids, and ids whose characters, are gathered at once.
GATHERED = 50_000
#: What the library takes off the least score for a character outside the pieces of a unigram model.
UNKNOWN_PENALTY = 10.0
#: An odd base for numbers of stretches; 64 bits tell the pieces' numbers apart, which the compiler checks.
BASE = 0x9E3779B97F4A7C15
MERGES, UNIGRAM = 2, 1
#: The model's file on every node, from the installed package of public vocabularies.
MODEL = "piece_bpe_32k.model"

ENCODED = "doc_id long, n_chars long, n_tokens long, n_byte_tokens long, ids array<int>, round_trip boolean"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        elif tag & 7 == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if tag & 7 == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class Transducer:
    """A compiled model. ``encode`` gives a text's ids, ``decode`` the text of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.text: list[str] = []
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.plain: list[bool] = []
        self.unknown, self.dummy, kind, charmap = 0, True, 1, b""
        for field, value in _fields(raw):
            if field == 1:
                piece, score, sort = "", 0.0, 1
                for f, v in _fields(value):
                    if f == 1:
                        piece = v.decode("utf-8")
                    elif f == 2:
                        score = struct.unpack("<f", v)[0]
                    elif f == 3:
                        sort = v
                n = len(self.text)
                self.text.append(piece)
                self.plain.append(sort in (1, 4))
                if sort == 1:
                    self.score[piece], self.id[piece] = score, n
                elif sort == 6:
                    self.bytes[int(piece[3:5], 16)] = n
                elif sort == 2:
                    self.unknown = n
            elif field == 2:
                kind = next((v for f, v in _fields(value) if f == 3), 1)
            elif field == 3:
                flags = dict(_fields(value))
                charmap, self.dummy = flags.get(2, b""), bool(flags.get(3, 1))
                if flags.get(4, 1):
                    raise ValueError("a model that removes white space isn't supported")
        if kind not in (MERGES, UNIGRAM) or charmap:
            raise ValueError("only merge and unigram models with the identity map are supported")
        if kind == UNIGRAM and len(self.bytes) < 256:
            raise ValueError("a unigram model without byte fallback isn't supported")
        if kind == UNIGRAM and max(self.score.values(), default=0.0) > 0:
            raise ValueError("a unigram model with positive scores isn't supported")
        if any(APART in p for p in self.id):
            raise ValueError("a piece of this model holds the null character")
        self.kind = kind
        self.outside = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        if any(SPACE in p[1:] and p.strip(SPACE) for p in self.id):
            raise ValueError("a piece of this model goes across words")
        self.value = {n: b for b, n in self.bytes.items()}
        #: Ids of the words of the last batch.
        self._now: dict[bytes, bytes] = {}
        self.space = self.id.get(SPACE, OUTSIDE + ord(SPACE))
        #: Of a model of merges, pieces that their own merges reach; the others are on no path.
        reached = [p for p in self.id if kind == UNIGRAM or self.merge(p) == (p,)]
        numbers = {p: self._number(p) for p in reached}
        if len(set(numbers.values())) < len(numbers):
            raise ValueError("two pieces of this model share a number")
        known = sorted(reached, key=numbers.get)
        self.number, self.known = np.array([numbers[p] for p in known], np.uint64), np.array([self.id[p] for p in known], np.int64)
        self.seen = np.zeros(1 << 21, bool)
        self.seen[self._slot(self.number)] = True
        #: Runs of spaces take no part in a word's lattice in a model of merges.
        self.deepest = max((len(p) for p in reached if kind == UNIGRAM or p.strip(SPACE)), default=1)
        self.single = np.zeros(0x110000, bool)
        self.single[[ord(p) for p in reached if len(p) == 1]] = True
        self.added = np.array([-self.score.get(t, 0.0) for t in self.text])
        if kind == MERGES:
            self._edges(reached)
        #: Neighbours inside some piece: between others no arc reaches, and a word falls into parts.
        self.inside = frozenset(p[i : i + 2] for p in self.id for i in range(len(p) - 1))

    def forget(self) -> None:
        """Give the remembered words back; an idle worker keeps only the compiled tables."""
        self._now = {}

    # -- arcs and weights -------------------------------------------------------------------------

    @staticmethod
    def _number(piece: str) -> int:
        """A piece's number: its characters as digits of an odd base, in 64 bits."""
        out = 0
        for c in piece:
            out = (out * BASE + ord(c) + 1) % (1 << 64)
        return out

    def arcs(self, joined: str, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lattices of normalised words, joined by ``APART`` at the places ``apart``: begin, end and label of the arcs. The stretches of each
        length are numbered together, and those with a piece's number are arcs."""
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        digit = code.astype(np.uint64) + np.uint64(1)
        number, begin, end, label = digit, [], [], []
        for size in range(1, min(self.deepest, len(code)) + 1):
            if size > 1:
                number = number[:-1] * np.uint64(BASE) + digit[size - 1 :]
            some = np.flatnonzero(self.seen[self._slot(number)])
            at = np.minimum(np.searchsorted(self.number, number[some]), len(self.number) - 1)
            hit = self.number[at] == number[some]
            begin.append(some[hit])
            end.append(some[hit] + size)
            label.append(self.known[at[hit]])
        alone = ~self.single[code]  # byte fallback
        alone[apart] = False
        other = np.flatnonzero(alone)
        return np.concatenate([*begin, other]), np.concatenate([*end, other + 1]), np.concatenate([*label, OUTSIDE + code[other].astype(np.int64)])

    def merge(self, text: str, least: int = 1) -> tuple[str, ...]:
        """The model's merges of a short string, best score first, then leftmost, until ``least`` parts are left."""
        parts, score = list(text), self.score.get
        while len(parts) > least:
            best, at = -INFINITE, -1
            for k in range(len(parts) - 1):
                s = score(parts[k] + parts[k + 1], -INFINITE)
                if s > best:
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(parts)

    def _edges(self, reached: list[str]) -> None:
        """For each piece the parts that stand at its right and left edge while it is merged, with the rank that ends
        each; and the rank of every pair of pieces that may merge."""
        halves = {p: self.merge(p, 2) for p in reached if len(p) > 1}

        def edge(p: str, side: int) -> list[tuple[int, float]]:
            out, until = [], INFINITE
            while True:
                out.append((self.id[p], until))
                if p not in halves:
                    return out
                until, p = -self.score[p], halves[p][side]

        self.edge, self.until = [], []
        for side in (1, 0):
            edges = {self.id[p]: edge(p, side) for p in reached}
            deep = max(map(len, edges.values()))
            ids, ends = np.full((deep, len(self.text)), -1, np.int32), np.zeros((deep, len(self.text)), np.float32)
            for i, parts in edges.items():
                for k, (part, until) in enumerate(parts):
                    ids[k, i], ends[k, i] = part, until
            self.edge.append(ids)
            self.until.append(ends)
        pairs = {self.id[p[:k]] << 24 | self.id[p[k:]]: -self.score[p] for p in self.id for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id}
        self.pair = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k] for k in self.pair.tolist()], np.float32)
        self.likely = np.zeros(1 << 21, bool)
        self.likely[self._slot(self.pair)] = True

    @staticmethod
    def _slot(pair: np.ndarray) -> np.ndarray:
        return (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)

    def _ranks(self, pair: np.ndarray) -> np.ndarray:
        out = np.full(len(pair), INFINITE, np.float32)
        some = np.flatnonzero(self.likely[self._slot(pair)])
        at = np.minimum(np.searchsorted(self.pair, pair[some]), len(self.pair) - 1)
        hit = self.pair[at] == pair[some]
        out[some[hit]] = self.rank[at[hit]]
        return out

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two pieces can't stand together: a part at the one's right edge merges with one at the other's left
        edge before either is merged into its own (at equal ranks the left one is)."""
        bad = np.zeros(len(left), bool)
        (rights, lefts), (ends, begins) = self.edge, self.until
        live = np.arange(len(left))
        for x, until in zip(rights, ends, strict=True):
            live = live[x[left[live]] >= 0]
            on = live = live[~bad[live]]
            for y, since in zip(lefts, begins, strict=True):
                on = on[y[right[on]] >= 0]
                if not len(on):
                    break
                a, b = left[on], right[on]
                rank = self._ranks(x[a].astype(np.int64) << 24 | y[b])
                hit = (rank < until[a]) & (rank <= since[b])
                bad[on[hit]] = True
                on = on[~hit]
            if not len(live):
                break
        return bad

    def weights(self, left: np.ndarray, label: np.ndarray) -> np.ndarray:
        """What arcs ``label`` weigh out of states whose last piece is ``left`` (-1: the begin)."""
        if self.kind == UNIGRAM:
            return np.where(label < OUTSIDE, self.added[np.minimum(label, len(self.added) - 1)], -self.outside)
        out = np.zeros(len(label))
        some = np.flatnonzero((left >= 0) & (left < OUTSIDE) & (label < OUTSIDE))  # nothing joins a character outside the pieces
        pair, which = np.unique(left[some] << 24 | label[some], return_inverse=True)
        out[some] = np.where(self.apart(pair >> 24, pair & 0xFFFFFF), INFINITE, 0.0)[which]
        return out

    # -- shortest path ----------------------------------------------------------------------------

    def paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The labels on the shortest path of each word, one word behind the other, and how many each has. A character
        outside the pieces stands as itself."""
        joined = APART.join(words)
        size = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(size + 1) - size - 1
        begin, end, label = self.arcs(joined, first[1:] - 1)
        step = end - np.repeat(first, size + 1)[end]
        order = np.argsort(step, kind="stable")
        begin, end, label = begin[order], end[order], label[order]
        steps = np.concatenate(([0], np.cumsum(np.bincount(step))))
        least, back, last = np.full(len(joined) + 1, INFINITE), np.zeros(len(joined) + 1, np.int64), np.full(len(joined) + 1, -1, np.int64)
        least[first] = 0.0
        for lo, hi in zip(steps, steps[1:], strict=False):
            if lo == hi:
                continue
            come, to, by = begin[lo:hi], end[lo:hi], label[lo:hi]
            total = least[come] + self.weights(last[come], by)
            on = np.argsort(-total, kind="stable")  # the least sum into a state is set last
            on = on[total[on] < INFINITE]
            least[to[on]], back[to[on]], last[to[on]] = total[on], come[on], by[on]
        at, whose, out = first + size, np.arange(len(words)), []
        while len(whose):
            going = at > first[whose]
            at, whose = at[going], whose[going]
            out.append((whose, last[at]))
            at = back[at]
        owner = np.concatenate([w for w, _ in out])[::-1]
        labels = np.concatenate([x for _, x in out])[::-1]
        return labels[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def path(self, word: str) -> list[int]:
        """The shortest path of a word of any length, in pieces where no arc reaches across."""
        cuts = [0, *(j for j in range(1, len(word)) if word[j - 1 : j + 1] not in self.inside), len(word)]
        parts = [word[a:b] for a, b in pairwise(cuts)]
        return [i for k in range(0, len(parts), TOGETHER) for i in self.paths(parts[k : k + TOGETHER])[0].tolist()]

    def spaces(self, n: int) -> list[int]:
        """A run of spaces: pieces of one score, so the leftmost pair joins first."""
        if n <= 64:
            return [self.id.get(p, OUTSIDE + ord(SPACE)) for p in self.merge(SPACE * n)]
        first = self.spaces(64)[0]  # a longer run begins with the same pieces
        step = len(self.text[first]) if first < OUTSIDE else 1
        return [first] * ((n - 48) // step) + self.spaces(n - (n - 48) // step * step)

    def _spelled(self, labels: list[int]) -> list[int]:
        return [i for code in labels for i in (self._bytes_of(code) if code >= OUTSIDE else (code,))]

    def _bytes_of(self, code: int) -> list[int]:
        if len(self.bytes) < 256:
            return [self.unknown]
        return [self.bytes[b] for b in chr(code - OUTSIDE).encode("utf-8", "surrogatepass")]

    def word(self, word: str) -> list[int]:
        """Ids of a normalised word (with the spaces before it)."""
        body = word.lstrip(SPACE)
        run = len(word) - len(body)
        if self.kind == UNIGRAM:
            ids = self.path(word)
        elif body:
            # only the last space can join the word; the others join one another after it has
            ids = self.path(SPACE + body if run else body)
            if run > 1:
                ids = self.spaces(run) + ids[1:] if ids[0] == self.space else self.spaces(run - 1) + ids
        else:
            ids = self.spaces(run)
        return self._spelled(ids) if max(ids) >= OUTSIDE else ids

    def packed(self, words: list[bytes]) -> list[bytes]:
        """Ids of the distinct words of a batch, their spaces as they are, as 32-bit numbers."""
        out = list(map(self._now.get, words))
        new = [k for k, x in enumerate(out) if x is None]
        for lo in range(0, len(new), TOGETHER):
            some = new[lo : lo + TOGETHER]
            raw = b"\0".join([words[k] for k in some]).decode("utf-8").replace(" ", SPACE).split("\0")
            spelled = raw if len(raw) == len(some) else [words[k].decode("utf-8").replace(" ", SPACE) for k in some]
            plain = [n for n, w in enumerate(spelled) if len(w) < LONG and (self.kind == UNIGRAM or not w.startswith(SPACE, 1)) and w != SPACE]
            labels, count = self.paths([spelled[n] for n in plain]) if plain else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            end = np.cumsum(count)
            flat = labels.astype(np.int32).tobytes()
            for n, a, b in zip(plain, ((end - count) * 4).tolist(), (end * 4).tolist(), strict=True):
                out[some[n]] = flat[a:b]
            for k in np.flatnonzero(np.bincount(np.repeat(np.arange(len(plain)), count), labels >= OUTSIDE, len(plain))) if plain else ():
                out[some[plain[k]]] = array("i", self._spelled(labels[end[k] - count[k] : end[k]].tolist())).tobytes()
            for n in set(range(len(some))).difference(plain):
                out[some[n]] = array("i", self.word(spelled[n])).tobytes()
        self._now = dict(zip(words, out, strict=True))
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        normalised = (SPACE if self.dummy else "") + text.replace(" ", SPACE)
        return [i for w in WORD.findall(normalised) for i in self.word(w)]

    def decode(self, ids) -> str:
        """The inverse transducer: pieces to characters, bytes to the characters they spell, spaces back."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.value:
                held.append(self.value[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.text[i] if self.plain[i] else "")
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.dummy and text.startswith(" ") else text


#: A word with the spaces before it, or the spaces at the end.
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

_COMPILED: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """One machine a worker and model."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range behind the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _bounds(size: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(size)))


class _Batch:
    """Encodes and checks a batch of texts at once."""

    def __init__(self, machine: Transducer):
        self.machine = machine
        spelled = [bytes([machine.value[i]]) if i in machine.value else t.replace(SPACE, " ").encode() if plain else b"" for i, (t, plain) in enumerate(zip(machine.text, machine.plain, strict=True))]
        #: The inverse transducer's output of each id.
        self.spelled, self.spelled_at = np.frombuffer(b"".join(spelled), np.uint8), _bounds(np.array([len(x) for x in spelled]))
        self.bytes = np.zeros(len(spelled), bool)
        self.bytes[list(machine.value)] = True

    def normalised(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The normaliser's output, spaces as they are: bytes of all texts, and where each begins and ends."""
        column = pc.replace_substring(column.cast(pa.large_string()), SPACE, " ")
        if self.machine.dummy:
            column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar(" ", pa.large_string())))
        _, at, data = column.buffers()
        at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), at - at[0]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64)
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[at[:-1][at[:-1] < at[1:]]] = True
        starts = np.flatnonzero(begins)
        bounds = np.append(starts, len(data))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        packed = self.machine.packed(words.dictionary.to_pylist())
        pool, size = np.frombuffer(b"".join(packed), np.int32), np.array([len(p) // 4 for p in packed], np.int64)
        first, number = _bounds(size), words.indices.to_numpy()
        out = [pool[_ranges(first[part], size[part])] for k in range(0, len(number), GATHERED) for part in (number[k : k + GATHERED],)]
        of_text = np.searchsorted(starts, at)
        return np.concatenate(out), np.diff(_bounds(size[number])[of_text])

    def same(self, data: np.ndarray, at: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Whether decoding gives each normalised text back."""
        size = np.diff(self.spelled_at)
        edge = _bounds(count)
        length = np.diff(_bounds(size[ids])[edge])
        same = length == np.diff(at)
        if not same.all():
            return np.array([ok and self._equal(data[a:b], ids[c:d]) for ok, a, b, c, d in zip(same, at, at[1:], edge, edge[1:], strict=False)], bool)
        wrong, done = np.zeros(len(data), bool), 0
        for k in range(0, len(ids), GATHERED):
            part = ids[k : k + GATHERED]
            got = self.spelled[_ranges(self.spelled_at[part], size[part])]
            wrong[done : done + len(got)] = data[done : done + len(got)] != got
            done += len(got)
        return np.diff(_bounds(wrong)[at]) == 0

    def _equal(self, data: np.ndarray, ids: np.ndarray) -> bool:
        return all(self.same(data, np.array([0, len(data)]), ids, np.array([len(ids)]))) if len(ids) else not len(data)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_tokens, n_byte_tokens, ids, round_trip (decoding gives the text back) of every whole text."""
    bound_batches(docs.sparkSession)
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        coder = _Batch(machine)
        for batch in batches:
            column = batch.column("text")
            data, at = coder.normalised(column)
            ids, count = coder.encode(data, at)
            edge = _bounds(count)
            fallback = np.diff(_bounds(coder.bytes[ids])[edge])
            same = coder.same(data, at, ids, count) & ~pc.match_substring(column, SPACE).to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pc.utf8_length(column).cast(pa.int64()), pa.array(count, pa.int64()), pa.array(fallback, pa.int64()), lists, pa.array(same, pa.bool_())],
                names=["doc_id", "n_chars", "n_tokens", "n_byte_tokens", "ids", "round_trip"],
            )
        machine.forget()
        trim()

    return texts(docs).mapInArrow(run, ENCODED)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of encoded rows; null ids give an empty text."""
    bound_batches(encoded.sparkSession)
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for batch in batches:
            out = [machine.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
