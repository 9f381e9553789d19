"""Best-fit packing with certificates: documents into sequences of at most `capacity` tokens.

Documents are tokenised in one pass; longer ones are cut into pieces. Pieces are dealt to groups of bounded size
and packed by best-fit decreasing. A group whose number of bins equals its lower bound by dual feasible functions
is certified. Groups that are not give up their bins with gaps; those pieces are dealt anew to fewer groups and
packed again, until all groups are certified, one group is left, or a round gains nothing. Each piece carries the
number of bins of its last group and that group's bound, so that what is not certified can be told.

Edge cases: a null or empty text is one piece, the end id alone; pieces of full length are sequences of their
own; repeated rows are packed each; ties in length are broken by piece number; an empty table gives an empty
result; extra columns have no effect.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, written

CAPACITY, END_ID = 2048, 0
#: Pieces of a group, about; gap up to which a sequence counts as full.
GROUP, SLACK = 20_000, 8

#: Texts whose ids follow from the word rules below, unless they hold the mark of special tokens. Other texts go through
#: the tokenizer itself, white-space token by token; with separators that are white space for split() alone, as a whole.
PLAIN = re.compile(r"[\t-\r\x20-\x7e¡-±´-¸º»¿-ÿ]*")
WORDS = re.compile(r"[^\W\d_]+|\d|'(?:[stmd]|re|ve|ll)|(?:[^\s\w]|_)+")
MARK, SEPARATORS = "<|", ("\x1c", "\x1d", "\x1e", "\x1f")
#: Words that a worker remembers, and tokens of other texts.
REMEMBERED = 400_000
#: Characters whose tokens are told at once, about.
AT_ONCE = 500_000


class Remembered(dict):
    """A dictionary of bounded size: when it is full, what was used since it last was stays."""

    def __init__(self, of: Callable[[str], bytes], most: int = REMEMBERED):
        super().__init__()
        self.of, self.most, self.before = of, most // 2, {}

    def __missing__(self, key: str) -> bytes:
        value = self.before.get(key)
        if value is None:
            value = self.of(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value

    def keep(self, known: Iterable[tuple[str, bytes]]) -> None:
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self.update(known)


class WordTokenizer:
    """Ids of whole texts, as little-endian unsigned 32-bit numbers. For tokenizers whose tokens never cross words.

    Such a tokenizer gives the same ids for a text as for its words one by one, so each distinct word is encoded once
    and remembered; what a group of texts brings anew is encoded in one call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.joined = Tokenizer(self.whole.model)
        self.joined.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        suffix = self.whole.model.end_of_word_suffix
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        self.ends[[i for t, i in self.whole.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {c: chr(c) if c < 128 else level.pre_tokenize_str(chr(c))[0][0] for c in range(256)}
        self.words, self.tokens = Remembered(self.word), Remembered(self.encoded)

    def word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.whole.model.tokenize(self.as_shown(word))]).tobytes()

    def as_shown(self, text: str) -> str:
        """text in the characters by which the model's vocabulary writes bytes."""
        return text if text.isascii() else text.translate(self.shown)

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of different words; those of new ones are told in one call, as each word's last id is one that ends words."""
        ids = list(map(self.words.get, words))
        unknown = [i for i, x in enumerate(ids) if x is None]
        new = [words[i] for i in unknown if words[i] not in self.words.before]
        if new and self.ends.any():
            found = np.array(self.joined.encode_batch_fast([self.as_shown(" ".join(new))], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[found]) + 1)).tolist()
            if len(cuts) == len(new):
                data = found.tobytes()
                self.words.keep((w, data[a:b]) for w, a, b in zip(new, [0, *cuts[:-1]], cuts, strict=True))
        for i in unknown:
            ids[i] = self.words[words[i]]
        return ids

    def encoded(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def by_words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a plain text in lower case; and where its words start, with the number of ids before each."""
        data = np.frombuffer(text.encode("latin-1"), "u1")
        starts, ends = word_places(data)
        _, first, which = np.unique(place_hashes(data, starts, ends), return_index=True, return_inverse=True)
        words = [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        ids = self.ids_of(words)
        flat, sizes = np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], "i8")
        n = sizes[which]
        before = np.cumsum(n) - n
        source = np.arange(n.sum()) + np.repeat((np.cumsum(sizes) - sizes)[which] - before, n)
        return flat[source], np.stack([starts, before])

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; plain ones are taken together."""
        plain = [bool(PLAIN.fullmatch(t)) and MARK not in t for t in texts]
        found: list[list[bytes]] = [[] for _ in texts]
        for group in _joined((i, part) for i, t in enumerate(texts) if plain[i] for part in _parts(t)):
            lengths = np.array([len(part) for _, part in group])
            at = np.cumsum(lengths + 1) - (lengths + 1)
            ids, placed = self.by_words(" ".join(part.lower() for _, part in group))
            cuts = np.append(placed[1], len(ids))[np.searchsorted(placed[0], np.append(at, at[-1] + lengths[-1] + 1))]
            data = ids.tobytes()
            for (i, _), a, b in zip(group, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                found[i].append(data[4 * a : 4 * b])
        for text, ok, parts in zip(texts, plain, found, strict=True):
            if ok:
                yield b"".join(parts)
            elif any(x in text for x in SEPARATORS):
                yield self.encoded(text)
            else:
                yield b"".join(map(self.tokens.__getitem__, text.split()))


#: What a Latin-1 character is: 0 white space, 1 a letter, 2 a digit, 3 anything else.
KIND = np.array([0 if chr(c).isspace() else 1 if chr(c).isalpha() else 2 if 48 <= c <= 57 else 3 for c in range(256)], "u1")
#: A random number for each character and an odd one for places, for hashes of words within one text.
_RANDOM = np.random.default_rng(5)
OF_CHARACTER, BASE = _RANDOM.integers(0, 1 << 64, 256, "u8"), int(_RANDOM.integers(0, 1 << 63)) * 2 + 1


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words that WORDS finds in plain text in lower case, by Latin-1 characters."""
    kind, n = KIND[data], len(data)
    start = np.ones(n + 4, bool)
    start[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    quotes = np.flatnonzero(data == ord("'"))
    quotes = quotes[start[quotes]]
    if len(quotes):
        after = np.append(data, np.zeros(3, "u1"))
        one, two = after[quotes + 1], after[quotes + 2]
        short = np.isin(one, np.frombuffer(b"stmd", "u1"))
        long = np.isin(one.astype("u2") * 256 + two, np.array([x[0] * 256 + x[1] for x in (b"re", b"ve", b"ll")], "u2"))
        start[quotes[short | long] + 1] = False
        start[quotes[short] + 2] = True
        start[quotes[long] + 3] = True
    starts = np.flatnonzero(start[:n])
    ends = np.append(starts[1:], n)
    words = kind[starts] > 0
    return starts[words], ends[words]


def place_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of what stands between each start and end: differences of a polynomial's running sums."""
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum(OF_CHARACTER[data] * power[: len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts]


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse among 64-bit numbers."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, AT_ONCE + AT_ONCE // 2)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(size, x, "u8")])) for x in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def _parts(text: str) -> Iterator[str]:
    """Parts of about AT_ONCE characters at most, cut before white space; of more where there is none for long."""
    while len(text) > AT_ONCE:
        cut = max(text.rfind(x, AT_ONCE // 2, AT_ONCE) for x in " \n\t")
        if cut < 0:
            break
        yield text[:cut]
        text = text[cut:]
    yield text


def _joined(parts: Iterable[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Groups of parts of about AT_ONCE characters together."""
    group: list[tuple[int, str]] = []
    size = 0
    for i, part in parts:
        if group and size + len(part) > AT_ONCE:
            yield group
            group, size = [], 0
        group.append((i, part))
        size += len(part)
    if group:
        yield group


_OPEN: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    """One for each worker process and file."""
    if path not in _OPEN:
        _OPEN[path] = WordTokenizer(path)
    return _OPEN[path]


PIECES = "doc_id long, piece int, start long, length long, ids binary"


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit): every document's ids and the end id, cut at capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = tokenizer_at(path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            for first, last in _groups(texts):
                out: list[tuple] = []
                for doc_id, ids in zip(batch["doc_id"][first:last].to_pylist(), encode(texts[first:last]), strict=True):
                    ids += end
                    for k, i in enumerate(range(0, len(ids), step)):
                        out.append((doc_id, k, i // 4, len(part := ids[i : i + step]) // 4, part))
                yield _rows(out)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(giving_back(run), PIECES)


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about AT_ONCE characters together."""
    first, size = 0, 0
    for i, text in enumerate(texts, 1):
        size += len(text)
        if size >= AT_ONCE or i == len(texts):
            yield first, i
            first, size = i, 0


def _rows(out: list[tuple]) -> pa.RecordBatch:
    doc, piece, start, length, ids = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that no packing can do without: the best of two families of dual feasible functions.

    f_e counts a length over capacity - e as a whole sequence and one under e as nothing; u_k rounds (k + 1) shares.
    """
    lengths = np.asarray(lengths, "i8")
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    sizes = np.arange(capacity + 1)
    number, weight = np.cumsum(count), np.cumsum(count * sizes)
    e = np.arange(0, capacity // 2 + 1)
    inner = weight[capacity - e] - np.where(e > 0, weight[np.maximum(e - 1, 0)], 0)
    best = int((-(-(inner + capacity * (number[-1] - number[capacity - e])) // capacity)).max())
    for k in range(1, 21):
        share = (k + 1) * sizes
        scaled = np.where(share % capacity == 0, sizes * k, (share // capacity) * capacity)  # u_k(x) * k * capacity / ...
        best = max(best, -(-int((count * scaled).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length its bin and place there; and the bins' fills. Each length goes where least room is left."""
    bins, places, fills = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8"), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin has room r
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], places[i] = b, fills[b]
        fills[b] += n
        if left := room - n:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, places, np.array(fills, "i8")


def _packed(capacity: int, slack: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pid", ignore_index=True)
        bins, places, fills = best_fit_decreasing(rows["length"].to_numpy(), capacity)
        bound = lower_bound(rows["length"].to_numpy(), capacity)
        done = (fills >= capacity - slack) | (len(fills) == bound)
        first = np.zeros(len(fills), "i8")
        first[bins[places == 0]] = rows["pid"][places == 0]
        return pd.DataFrame({"pid": rows["pid"], "length": rows["length"], "sequence_id": first[bins], "offset": places, "done": done[bins], "bins": len(fills), "bound": bound})

    return run


PACKED = "pid long, length long, sequence_id long, offset long, done boolean, bins long, bound long"


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, slack: int = SLACK) -> DataFrame:
    """pid, sequence_id, offset, bins, bound for each of pieces (pid, length): pid unique, length from 1 to capacity.

    sequence_id is the pid of a sequence's first piece. bins is the number of sequences in the group in which a piece was packed at last, bound what it can't do without.
    """
    one = F.lit(1).cast("long")
    out = pieces.where(F.col("length") == capacity).select("pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), one.alias("bins"), one.alias("bound"))
    rest = pieces.where(F.col("length") < capacity).select("pid", "length")
    left, given_up, former, r = rest.count(), None, None, 0
    while left:
        groups = math.ceil(left / group)
        dealt = rest.withColumn("g", F.pmod(F.xxhash64("pid", F.lit(r)), F.lit(groups)))
        packed = written(dealt.groupBy("g").applyInPandas(_packed(capacity, slack), PACKED), "packed")
        placed = packed.drop("length")
        starts = F.col("offset") == 0
        used, still, left = packed.agg(F.count_if(starts), F.count_if(starts & ~F.col("done")), F.count_if(~F.col("done"))).first()
        if given_up is not None and used >= given_up:  # nothing gained: the former sequences stay
            return out.unionByName(former)
        if groups == 1:
            return out.unionByName(placed.drop("done"))
        out = out.unionByName(placed.where("done").drop("done"))
        former, given_up, rest, r = placed.where("not done").drop("done"), still, packed.where("not done").select("pid", "length"), r + 1
    return out


def packed_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset, bins, bound: one row for each piece of each row of docs.

    ids are little-endian unsigned 32-bit numbers; who doesn't select them doesn't read them again.
    """
    pieces = tokenized_pieces(docs, path, capacity, end_id)
    kept = written(pieces.withColumn("ids_crc32", F.crc32("ids")), "pieces", row_id="pid")
    placed = pack(kept, capacity).withColumnRenamed("pid", "placed")
    return kept.join(placed, F.col("pid") == F.col("placed")).select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset", "bins", "bound")
