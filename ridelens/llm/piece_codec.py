"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

No piece reaches from a visible character into a following space mark, so merging never crosses the
start of a word and a text's pieces are those of its words. The new words of a batch lie one after
another in flat numpy arrays; every round finds each word's lowest pair rank, merges its leftmost
occurrences at once and compacts the arrays, until no pair remains.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.base import register, schema_of, table

SPACE_MARK = "▁"
_WORD = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")
_NONE = np.int64(1 << 40)
CACHED_BYTES = 48 << 20  # about what a task's remembered words may take
PART_BYTES = 1_000_000  # texts are encoded in runs of so many bytes


@dataclass
class Pieces:
    """A BPE vocabulary as plain arrays; its size is that of the model file.

    Symbols 0..n-1 are the pieces, further ones single characters that occur only inside pieces.
    """

    texts: list[str]
    plain: np.ndarray  # bool: a piece that merging can make
    byte_ids: np.ndarray  # id of each byte's piece
    end_id: int
    hidden: np.ndarray  # bool: control pieces, decoded as nothing

    @staticmethod
    def load(path: str) -> tuple[Pieces, np.ndarray]:
        """The vocabulary and each piece's rank (equal scores, equal ranks).

        Only models that leave the text as it is and put one space mark in front are supported.
        """
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("ﬁ  x ") != f"{SPACE_MARK}ﬁ{SPACE_MARK * 2}x{SPACE_MARK}":
            raise ValueError("the model changes texts before encoding")
        n = len(model)
        texts = [model.id_to_piece(i) for i in range(n)]
        hidden = np.array([model.is_control(i) for i in range(n)])
        plain = np.array([not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)) for i in range(n)])
        if any(model.is_unused(i) for i in range(n)) or any(SPACE_MARK in t.lstrip(SPACE_MARK) for t, p in zip(texts, plain) if p):
            raise ValueError("unused pieces or pieces that reach into the next word")
        bytes_ = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        if not all(model.is_byte(int(i)) for i in bytes_):
            raise ValueError("the model has no byte fallback")
        _, rank = np.unique(-np.array([model.get_score(i) for i in range(n)]), return_inverse=True)
        return Pieces(texts, plain, bytes_, model.eos_id(), hidden), rank.astype(np.int64)


class Codec:
    """Encodes and decodes batches of words; broadcast once; its size is that of the vocabulary."""

    def __init__(self, pieces: Pieces, rank: np.ndarray) -> None:
        self.pieces = pieces
        ids = {t: i for i, t in enumerate(pieces.texts) if pieces.plain[i]}
        symbols = dict(ids)
        for t in ids:
            for c in t:
                symbols.setdefault(c, len(pieces.texts) + len(symbols) - len(ids))
        self.n = len(pieces.texts) + len(symbols) - len(ids)
        pairs = {}
        beside = set()
        for t, i in ids.items():
            beside.update(zip(t, t[1:]))
            for cut in range(1, len(t)):
                a, b = symbols.get(t[:cut]), symbols.get(t[cut:])
                if a is not None and b is not None:
                    pairs[a * self.n + b] = i
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[int(k)] for k in self.keys], dtype=np.int64)
        self.rank = rank[self.made] if len(self.made) else self.made
        self.beside = np.array(sorted((ord(a) << 21) + ord(b) for a, b in beside), dtype=np.int64)
        chars = sorted((ord(t), s) for t, s in symbols.items() if len(t) == 1)
        self.chars, self.char_symbols = (np.array(x, dtype=np.int64) for x in zip(*chars))
        self.byte_of = {int(i): b for b, i in enumerate(pieces.byte_ids)}
        self.shown = ["" if h else t.replace(SPACE_MARK, " ") for t, h in zip(pieces.texts, pieces.hidden)]
        self.decimals = [str(i) for i in range(len(pieces.texts))]
        self.is_byte = np.isin(np.arange(len(pieces.texts)), pieces.byte_ids)
        self.words: dict[str, tuple[str, bytes, str]] = {}
        self.held = 0

    @staticmethod
    def _find(table_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table_, values), max(len(table_) - 1, 0))
        return at, (table_[at] == values if len(table_) else np.zeros(len(values), bool))

    def _ranks(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and made piece of the pair that begins at each symbol; `_NONE` where there is none."""
        rank, made = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            may = np.flatnonzero((seg[:-1] == seg[1:]) & (sym[:-1] < self.n) & (sym[1:] < self.n))
            at, known = self._find(self.keys, sym[may] * self.n + sym[may + 1])
            may, at = may[known], at[known]
            rank[may], made[may] = self.rank[at], self.made[at]
        return rank, made

    @staticmethod
    def _starts(seg: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])

    @staticmethod
    def _merge(sym, seg, code, made, hit):
        """Symbols after the merges that begin at `hit` (no two of them overlap)."""
        sym = sym.copy()
        sym[hit] = made[hit]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        return sym[keep], seg[keep], code[keep]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all words one after another, and the place where each word's begin, with the end
        (words hold space marks instead of spaces)."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not len(code):
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        at, known = self._find(self.chars, code)
        sym = np.where(known, self.char_symbols[at], self.n + 1)
        # no merge reaches over two characters that stand side by side in no piece
        apart = ~self._find(self.beside, (code[:-1] << 21) + code[1:])[1] | (word[1:] != word[:-1])
        seg = np.cumsum(np.r_[False, apart])
        pos = np.arange(len(code))  # of a symbol's first character: the order in which symbols are put together
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = self._ranks(sym, seg)
        while len(sym):
            starts = self._starts(seg)
            size = np.diff(np.r_[starts, len(seg)])
            low = np.minimum.reduceat(rank, starts)
            live = np.repeat(low < _NONE, size)
            if not live.all():
                done.append((pos[~live], sym[~live]))
                sym, seg, pos, rank, made = (x[live] for x in (sym, seg, pos, rank, made))
                size, low = size[low < _NONE], low[low < _NONE]
                if not len(sym):
                    break
                starts = np.r_[0, np.cumsum(size)[:-1]]
            hit = np.flatnonzero(rank == np.repeat(low, size))
            run = np.r_[True, hit[1:] != hit[:-1] + 1]  # of hits that overlap, every second one, from the left
            hit = hit[(np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
            new = self._merge(sym, seg, pos, made, hit)
            new_rank, new_made = self._ranks(new[0], new[1])
            # A merge may make a pair that comes before the word's other merges: such words take one merge now.
            early = np.minimum.reduceat(new_rank, self._starts(new[1])) <= low
            if early.any():
                owner = np.searchsorted(starts, hit, "right") - 1
                hit = hit[~early[owner] | np.r_[True, owner[1:] != owner[:-1]]]
                new = self._merge(sym, seg, pos, made, hit)
                new_rank, new_made = self._ranks(new[0], new[1])
            (sym, seg, pos), rank, made = new, new_rank, new_made
        pos, sym = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(pos, kind="stable")
        pos, sym = pos[order], sym[order]
        owner, odd = word[pos], sym >= len(self.pieces.texts)
        if odd.any():  # characters without a piece become the pieces of their bytes
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in code[pos[odd]].tolist()]
            size = np.ones(len(sym), np.int64)
            size[odd] = [len(r) for r in raw]
            sym, owner, odd = (np.repeat(x, size) for x in (sym, owner, odd))
            sym[odd] = self.pieces.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return sym, np.searchsorted(owner, np.arange(len(words) + 1))

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of piece ids; `first`: they begin a text, whose leading space mark is not part of it."""
        byte, shown = self.byte_of, self.shown
        if byte.keys().isdisjoint(ids):
            text = "".join([shown[i] for i in ids])
        else:
            out, raw = [], bytearray()
            for i in ids:
                if i in byte:
                    raw.append(byte[i])
                    continue
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                out.append(shown[i])
            text = "".join([*out, raw.decode("utf-8", "replace")])
        return text[1:] if first and text.startswith(" ") else text

    def learn(self, texts_words: list[list[str]]) -> None:
        """Put the words of a batch into the cache, all new ones in one run of merge rounds."""
        if self.held > CACHED_BYTES:
            self.words, self.held = {}, 0
        new = list({w for words in texts_words for w in words} - self.words.keys())
        flat, cuts = self.encode_words(new)
        ids, raw = flat.tolist(), flat.astype(np.int32).tobytes()
        decimals, shown = [self.decimals[i] for i in ids], [self.shown[i] for i in ids]
        odd = np.diff(np.r_[0, np.cumsum(self.is_byte[flat])][cuts]) > 0
        for word, a, b, bytes_ in zip(new, cuts[:-1].tolist(), cuts[1:].tolist(), odd.tolist()):
            text = self.decode(ids[a:b], first=False) if bytes_ else "".join(shown[a:b])
            entry = self.words[word] = (" ".join(decimals[a:b]), raw[4 * a:4 * b], text)
            self.held += 300 + 2 * len(word) + len(entry[0]) + len(entry[1]) + 2 * len(text)

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[str, bytes, str]]:
        """Of each text: all ids with the end id, as decimals joined by a space and as int32 bytes, and the decoded text."""
        cut = [_WORD.findall(SPACE_MARK + t.replace(" ", SPACE_MARK)) if t else [] for t in texts]
        self.learn(cut)
        end, end_bytes = str(self.pieces.end_id), np.array([self.pieces.end_id], np.int32).tobytes()
        for words in cut:
            got = [self.words[w] for w in words]
            text = "".join([g[2] for g in got])
            yield " ".join([*[g[0] for g in got], end]), b"".join([*[g[1] for g in got], end_bytes]), text.removeprefix(" ")


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = True) -> DataFrame:
    """`id_col`, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array) and decoded, of every row.

    Encodes as the sentencepiece library does, with an end id only; decoding is the library's. Null and empty
    texts give the end id alone, repeated rows stay. Only the id and the text are read; the vocabulary is broadcast. A
    task holds a run of `PART_BYTES` (or one longer text), its ids as one flat buffer, and `CACHED_BYTES` of words.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Codec(*Pieces.load(model_path)))
    struct, arrow = schema_of("__id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            for part in _by_size(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(part.start, part.stop - part.start).to_pylist()]
                sizes, digests, flat, shown = [], ([], []), [], []
                for decimals, numbers, text in codec.encode_texts(texts):
                    sizes.append(len(numbers) // 4)
                    digests[0].append(hashlib.sha256(decimals.encode()).hexdigest())
                    digests[1].append(hashlib.sha256(text.encode("utf-8")).hexdigest())
                    if ids:
                        flat.append(numbers)
                    if decoded:
                        shown.append(text)
                columns = [batch.column(0).slice(part.start, len(texts)), pa.array(sizes, pa.int64()), *(pa.array(d, pa.string()) for d in digests)]
                if ids:
                    values = pa.Array.from_buffers(pa.int32(), sum(sizes), [None, pa.py_buffer(b"".join(flat))])
                    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(offsets, values, type=arrow.field("ids").type))
                if decoded:
                    columns.append(pa.array(shown, pa.string()))
                if texts:
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, struct).withColumnRenamed("__id", id_col)


def _by_size(texts: pa.Array, most: int | None = None) -> Iterator[slice]:
    """Runs of texts of at most `most` bytes together (a longer text alone)."""
    most, begin, size = most or PART_BYTES, 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if size and size + n > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += n
    yield slice(begin, len(texts))


@register("op8_piece_codec")
def op8_piece_codec(spark, sf_dir):
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ids=False, decoded=False)
