"""BPE with word ends over DataFrames, by a table of distinct words.

Texts are split into words block by block: a block is a run of texts of ``BLOCK`` characters (or one longer text) with a
dictionary of its own, so that a text becomes the places of its words in that dictionary.  The blocks' dictionaries make one
table of distinct words, each of which is encoded once; its ids are joined back to the blocks by the word, and to the texts
by block and place.  Decoding joins the ids to the table of pieces, which is as large as the vocabulary and so is broadcast; ids that
come from elsewhere are cut behind each piece that ends a word, and distinct runs are brought back in the same way.

The places are written in buckets by block, so that the last join moves the dictionaries to the places, not the places.
A word has one row a block at most, whatever its frequency.  What a task holds is one block and its dictionary.

Defined results.  Null texts count as empty, null ids as none; repeated rows give repeated rows, null keys stay; very long
texts are a block each, and words may be as long as they like; empty tables give empty frames.  Columns other than key and
text are not carried, so their names cannot clash.  Ids outside the vocabulary decode to nothing, as in the library.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemill.scratch import workdir

#: Characters (or ids) of a block, and chunks remembered while one is made.
BLOCK, CHUNKS = 48 << 20, 300_000
#: Texts a step.
STEP = 500
#: Words of a dictionary a row.
PAGE = 10_000
#: Fixed values of the format: the end of a word, and how words are split.
END = "</w>"
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Chunks of these code points, long the same in all versions of Unicode, are split here; others ask the file's own rules.
PLAIN = regex.compile("[!-՗Ḁ-ỿ‐-‧‰-⁞ぁ-ゖァ-ヺ一-鿌가-힣]*")
#: What Python splits at but Unicode doesn't count as white space.
CONTROLS = "\x1c\x1d\x1e\x1f"

Path = str | Callable[[], str]


def _bytes_as_letters() -> list[str]:
    """A letter for each byte: printable ones stand for themselves, the others take the code points from 256 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


LETTERS = _bytes_as_letters()


class WordBpe:
    """A vocabulary file: splits texts into chunks and words, and encodes words."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.ids: dict[str, int] = dict(spec["model"]["vocab"])
        self.ranks = {tuple(pair): (rank, "".join(pair)) for rank, pair in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cuts = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.rules = Tokenizer.from_file(path)
        self.bytes = {letter: byte for byte, letter in enumerate(LETTERS)}

    def chunks(self, text: str) -> Iterable[str]:
        """Pieces of a text that can be split by themselves: between white space and special tokens."""
        if any(c in text for c in CONTROLS):
            return [text]
        found = self.cuts.findall(text) if self.special else []
        if not found:
            return text.split()
        between = self.cuts.split(text)
        return [c for part, token in zip(between, [*found, ""], strict=True) for c in (*part.split(), token) if c]

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk, normalised; a special token is a word."""
        if chunk in self.special:
            return [chunk]
        if PLAIN.fullmatch(chunk):
            return WORD.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())  # lower-case sigma whatever follows
        out, at = [], 0
        for match in [*self.cuts.finditer(chunk), None]:
            part = self.rules.normalizer.normalize_str(chunk[at : match.start() if match else None])
            out += [bytes(map(self.bytes.__getitem__, w)).decode() for w, _ in self.rules.pre_tokenizer.pre_tokenize_str(part)]
            if match:
                out.append(match.group())
                at = match.end()
        return out

    def encode(self, word: str) -> list[int]:
        """Ids of one word: the pair of lowest rank is joined, the leftmost first, until none is left."""
        if word in self.special:
            return [self.special[word]]
        parts: list[str | None] = [LETTERS[b] for b in word.encode()]
        parts[-1] += END
        size = len(parts)
        before, behind = list(range(-1, size - 1)), list(range(1, size + 1))
        ranks = self.ranks
        queue = [(rank[0], i, rank[1]) for i in range(size - 1) if (rank := ranks.get((parts[i], parts[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, joined = heapq.heappop(queue)
            j = behind[i]
            if parts[i] is None or j >= size or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            behind[i] = behind[j]
            if behind[j] < size:
                before[behind[j]] = i
                if rank := ranks.get((joined, parts[behind[j]])):
                    heapq.heappush(queue, (rank[0], i, rank[1]))
            if before[i] >= 0 and (rank := ranks.get((parts[before[i]], joined))):
                heapq.heappush(queue, (rank[0], before[i], rank[1]))
        return [self.ids[p] for p in parts if p is not None]


class Runs:
    """Splits ids behind each one that ends a word."""

    def __init__(self, path: str) -> None:
        bpe = load(path)
        self.ends = np.zeros(max([*bpe.ids.values(), *bpe.special.values()]) + 1, bool)
        self.ends[[i for token, i in bpe.ids.items() if token.endswith(END)] + list(bpe.special.values())] = True

    def chunks(self, ids: list[int]) -> Iterable[str]:
        """Runs of ids, as decimal numbers joined by spaces."""
        own = np.array(ids, np.int64)
        known = (own >= 0) & (own < len(self.ends))
        stops = np.flatnonzero(~known | self.ends[np.where(known, own, 0)]) + 1
        return [" ".join(map(str, part.tolist())) for part in np.split(own, stops) if len(part)]

    def words(self, chunk: str) -> list[str]:
        """A run is a word."""
        return [chunk]


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One vocabulary a Python worker."""
    return WordBpe(path)


@lru_cache(maxsize=2)
def _runs(path: str) -> Runs:
    return Runs(path)


def _found(path: Path) -> str:
    return path if isinstance(path, str) else path()


def _number(n: int) -> bytes:
    """A place in few bytes: seven bits each, the last one with its high bit clear."""
    out = bytearray()
    while n >= 128:
        out.append(128 | n & 127)
        n >>= 7
    out.append(n)
    return bytes(out)


def _numbers(packed: bytes) -> np.ndarray:
    """The places that were packed one after the other."""
    own = np.frombuffer(packed, np.uint8)
    ends = np.flatnonzero(own < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = np.zeros(len(ends), np.int64)
    for i in range(int((ends - starts).max(initial=-1)) + 1):
        here = starts + i <= ends
        out[here] |= (own[starts[here] + i].astype(np.int64) & 127) << 7 * i
    return out


def _repacked(numbers: np.ndarray, texts: list[int]) -> list[bytes]:
    """Places packed anew, cut into texts of so many."""
    sizes = 1 + sum((numbers >= 1 << 7 * i).astype(np.int64) for i in range(1, 5))
    ends = np.concatenate([[0], sizes.cumsum()])
    out = np.empty(ends[-1], np.uint8)
    for i in range(int(sizes.max(initial=0))):
        here = sizes > i
        out[ends[:-1][here] + i] = (numbers[here] >> 7 * i & 127) | np.where(sizes[here] > i + 1, 128, 0)
    cuts = ends[np.cumsum([0, *texts])].tolist()
    whole = out.tobytes()
    return [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _by_frequency(packed: list[bytes], count: int, step: int) -> tuple[np.ndarray, Iterator[list[bytes]]]:
    """Places by falling frequency, and the texts in such places, ``step`` texts at a time: no array is as long as the block."""
    steps = range(0, len(packed), step)
    times = np.zeros(count, np.int64)
    for i in steps:
        times += np.bincount(_numbers(b"".join(packed[i : i + step])), minlength=count)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(count, np.int64)
    rank[order] = np.arange(count)

    def again() -> Iterator[list[bytes]]:
        for i in steps:
            numbers = [_numbers(x) for x in packed[i : i + step]]
            yield _repacked(rank[np.concatenate(numbers)], [len(x) for x in numbers])

    return order, again()


class _Places(dict):
    """Chunk to its words' places in the block's dictionary, filled on demand."""

    def __init__(self, words: Callable[[str], list[str]]) -> None:
        super().__init__()
        self.words, self.dictionary = words, {}

    def __missing__(self, chunk: str) -> bytes:
        known = self.dictionary
        out = b"".join(_number(known.setdefault(w, len(known))) for w in self.words(chunk))
        if len(chunk) <= 64 and len(self) < CHUNKS:
            self[chunk] = out
        return out


def _coded(docs: DataFrame, key: str, value: str, load_splitter: Callable[[], WordBpe | Runs]) -> DataFrame:
    """The blocks, written once in buckets: rows with ``places`` (one a text) and rows with ``words`` from place ``start`` on."""
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("key", docs.schema[key].dataType), T.StructField("places", T.BinaryType()),
        T.StructField("start", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, block, size, places = load_splitter(), None, 0, None
        keys: list[pa.Array] = []
        packed: list[bytes] = []

        def rows(key: pa.Array, place: list, start: list, words: list) -> pa.RecordBatch:
            columns = [pa.array([block] * len(key), pa.int64()), key, pa.array(place, pa.binary()), pa.array(start, pa.int32()), pa.array(words, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, ["block", "key", "places", "start", "words"])

        def ended() -> Iterator[pa.RecordBatch]:
            """The block, its words by frequency, so that the places of most are short."""
            known, key = list(places.dictionary), pa.concat_arrays(keys)
            order, again = _by_frequency(packed, len(known), STEP)
            for i, part in zip(range(0, len(key), STEP), again, strict=True):
                yield rows(key.slice(i, STEP), part, [None] * len(part), [None] * len(part))
            for i in range(0, len(known), PAGE):
                yield rows(pa.nulls(1, key.type), [None], [i], [[known[k] for k in order[i : i + PAGE].tolist()]])
            keys.clear()
            packed.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                start, ordinals = 0, part.column(0).to_pylist()
                for i, x in enumerate(part.column(2).to_pylist()):
                    if places is None or size >= BLOCK:
                        if places is not None:
                            keys.append(part.column(1).slice(start, i - start))
                            start = i
                            yield from ended()
                        block, size, places = ordinals[i], 0, _Places(splitter.words)
                    packed.append(b"".join(map(places.__getitem__, splitter.chunks(x))) if x is not None else b"")
                    size += len(x) if x is not None else 0
                keys.append(part.column(1).slice(start))
        if places is not None:
            yield from ended()

    coded = docs.select(F.monotonically_increasing_id().alias("block"), F.col(key), F.col(value)).mapInArrow(run, schema)
    spark = docs.sparkSession
    name = f"tidemill_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded.write.bucketBy(buckets, "block").option("compression", "zstd").option("path", f"{workdir(spark).rstrip('/')}/tidemill-{name}").saveAsTable(name)
    return spark.table(name)


def pieces(path: Path) -> pa.Array:
    """The vocabulary as a table of pieces by id, special tokens included."""
    bpe = load(_found(path))
    known = {i: t for t, i in {**bpe.ids, **bpe.special}.items()}
    return pa.array([known.get(i) for i in range(max(known) + 1)], pa.string())


def _looked_up(coded: DataFrame, path: Path, ids_of: Callable[[str], list[int]], kind: str) -> DataFrame:
    """``key, n_tokens, ids, decoded`` of each text: ids (of a numpy ``kind``) of every distinct word, brought back by block and place, and their pieces."""
    spark = coded.sparkSession
    listed = coded.where(F.col("words").isNotNull()).select("block", F.col("start"), F.posexplode("words").alias("i", "word"))
    # One exchange by word, of a number of partitions that stays, serves the distinct words and the way back; for that both ask
    # for the same columns: each word keeps its least place, and none comes before it.
    place = F.struct("block", "place")

    @F.pandas_udf("binary")
    def ids(words):  # noqa: ANN001, ANN202
        return words.map(lambda word: np.array(ids_of(word), kind).tobytes())

    listed = listed.select("block", (F.col("start") + F.col("i")).alias("place"), "word").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word")
    table = listed.groupBy("word").agg(F.min(place).alias("least")).withColumn("ids", ids("word"))
    back = listed.join(table, "word").where(place >= F.col("least")).select(F.col("block").alias("of"), "place", "ids")
    kept = coded.where(F.col("words").isNull()).select("block", "key", "places")
    schema = T.StructType([coded.schema["key"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    vocabulary = spark.sparkContext.broadcast(pieces(path))

    def gathered(texts: pa.Table, words: pa.Table) -> pa.Table:
        words, by_id = words.sort_by("place"), vocabulary.value
        every = words["ids"].to_pylist()
        sizes = np.array([len(x) // np.dtype(kind).itemsize for x in every], np.int64)
        flat, starts = np.frombuffer(b"".join(every), kind).astype(np.int32), np.cumsum(sizes) - sizes
        out = []
        for batch in texts.to_batches(max_chunksize=STEP):
            own = [_numbers(x) for x in batch.column("places").to_pylist()]
            places, ends = np.concatenate(own), np.cumsum([0, *map(len, own)])
            counts = sizes[places]
            total = np.concatenate([[0], counts.cumsum()])
            ids = flat[np.repeat(starts[places] - total[:-1], counts) + np.arange(total[-1])]
            lists = pa.ListArray.from_arrays(pa.array(total[ends], pa.int32()), pa.array(ids))
            known = (ids >= 0) & (ids < len(by_id))
            said = np.concatenate([[0], known.cumsum()])[total[ends]]  # ids outside the vocabulary say nothing
            decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(said, pa.int32()), by_id.take(pa.array(ids[known]))), " ")
            out.append(pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.diff(total[ends])), lists, decoded], ["key", "n_tokens", "ids", "decoded"]))
        return pa.Table.from_batches(out)

    return kept.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(gathered, schema)


def encode(docs: DataFrame, path: Path, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``n_tokens``, ``ids`` and ``decoded`` (the ids' pieces, joined by spaces) of every whole text.

    ``path`` may be a function, which each worker asks on its own machine.
    """

    coded = _coded(docs, key, text, lambda: load(_found(path)))
    kind = "<u2" if len(pieces(path)) <= 1 << 16 else "<i4"
    return _looked_up(coded, path, lambda word: load(_found(path)).encode(word), kind).withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: Path, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Key and ``decoded`` of every row of ids, wherever they come from."""
    coded = _coded(encoded, key, ids, lambda: _runs(_found(path)))
    return _looked_up(coded, path, lambda run: [int(x) for x in run.split(" ")], "<i4").select(F.col("key").alias(key), "decoded")
