"""Byte-pair coding of whole texts by tree concatenation, and helpers for coding in parts.

`TreeEncoder` codes halves of a text apart, as batches, and joins them by windows that are coded again. Texts of many
megabytes are first cut into slices at places where the tokenizer always starts anew: a single space between two other
characters, for byte-level BPE. `PieceTable` codes small pieces, each distinct one once: those of the tree's leaves and
windows, and for packing those of the word BPE.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import quoted, short_batches, single_thread, strings, with_struct

#: White space as the tokenizers see it: Python's, without the four ASCII separators.
_WS, _WORD = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
#: Latin-1 letters, and ASCII marks; a run of either ends where the tokenizer's own pre-tokens end.
_LETTER, _MARK = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"\x00-\x08\x0e-\x1f!-/:-@\[-`{-~\x7f"
#: For byte-level BPE by GPT-2's pattern: a piece is one pre-token, or a few of them where other characters join in.
BYTE_PIECE = re.compile(rf" ?[{_LETTER}]++(?![\u0100-\U0010ffff])|'(?:s|t|re|ve|m|ll|d)| ?[{_MARK}]++(?![^\x00-\x7f])| ?{_WORD}+|{_WS}+(?!{_WORD})|{_WS}")
#: For the word BPE, which folds case and composes characters first, and drops white space.
_SHORT = "'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])"
WORD_PIECE = re.compile(rf"[{_LETTER}]++(?![^\s\x00-\xff])|{_SHORT}(?![^\s\x00-\xff])|{_SHORT}{_WORD}+|[{_MARK}]++(?![^\x00-\x7f])|{_WORD}+")
BYTE_SAFE = re.compile(rf"(?<={_WORD}) (?={_WORD})")
#: Characters of a text taken at a time, of a leaf of the tree, and the bytes of a batch.
SLICE, LEAF, BATCH = 1 << 20, 2048, 1 << 17
#: Distinct pieces that a worker remembers, and the most characters of one.
REMEMBERED, SHORT = 300_000, 64


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    single_thread()
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def slices(text: str, safe: re.Pattern = BYTE_SAFE, size: int = SLICE) -> Iterator[str]:
    """Cut a text at safe boundaries into parts of about `size` characters; the boundary's space goes to the later part."""
    start = 0
    while len(text) - start > size:
        m = safe.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


@functools.lru_cache(maxsize=4)
def specials(path: str) -> re.Pattern | None:
    return specials_of(tokenizer(path))


def specials_of(t: Tokenizer) -> re.Pattern | None:
    """Strings that the tokenizer takes out of a text before anything else."""
    found = sorted((a.content for a in t.get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None


def independent(text: str, path: str, piece: re.Pattern) -> list[str]:
    return parted(text, specials(path), piece)


def parted(text: str, cut: re.Pattern | None, piece: re.Pattern) -> list[str]:
    """Pieces of a text that the tokenizer codes independently of one another."""
    if not cut or not cut.search(text):
        return piece.findall(text)
    return [p for i, part in enumerate(cut.split(text)) for p in ([part] if i % 2 else piece.findall(part))]


def byte_size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def batches(texts: list[str], most: int = BATCH) -> Iterator[list[str]]:
    """The texts in their order, in runs of about `most` bytes; a longer text is a run of its own."""
    run, held = [], 0
    for x in texts:
        size = byte_size(x) + 16
        if run and held + size > most:
            yield run
            run, held = [], 0
        run.append(x)
        held += size
    if run:
        yield run


class PieceTable:
    """Values of pieces: `code` computes them for a batch; the first `limit` distinct short pieces are remembered."""

    def __init__(self, code: Callable[[list[str]], list], limit: int = REMEMBERED):
        self.code, self.limit, self.known = code, limit, {}

    def __call__(self, pieces: list[str]) -> list:
        known = self.known
        missing = list(set(pieces).difference(known))
        if not missing:
            return [known[p] for p in pieces]
        fresh = {}
        for batch in batches(missing):
            fresh.update(zip(batch, self.code(batch), strict=True))
        out = [known[p] if p in known else fresh[p] for p in pieces]
        for p, v in fresh.items():
            if len(known) >= self.limit:
                break
            if len(p) <= SHORT:
                known[p] = v
        return out


@dataclass
class Node:
    """The coded stretch of a text from character `start` to `end`: where its pieces begin, and the ids of each."""

    start: int
    end: int
    starts: list[int]
    ids: list[list[int]]


def gpt2_pieces(t: Tokenizer) -> bool:
    """Whether the tokenizer parts texts by GPT-2's pattern alone, so that BYTE_PIECE holds."""
    said = json.loads(t.to_str())
    before, added = said["pre_tokenizer"] or {}, said["added_tokens"]
    plain = not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
    return plain and not said["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")


class TreeEncoder:
    """Tree concatenation: texts as the tokenizer codes them whole, from halves that are coded apart.

    A text is halved until its leaves have at most `leaf` characters. Leaves are coded in pieces, each distinct one once
    by the library (by pre-tokens as the library parts them, where it does not go by GPT-2's pattern). Neighbours are
    then joined pair by pair, level by level. The text around a join is coded again in a window that starts where the
    left side begins a piece and grows until it agrees with the right side on a place where both begin one. Pieces are
    found from left to right and coded alone, so that from there on both sides stay equal, and the joined ids are those
    of the whole. Near the end of a coded stretch nothing is trusted (`margin`), since what follows may change it; at a
    text's own end all is. Without such a place the window grows to the whole.
    """

    def __init__(self, t: Tokenizer, leaf: int = LEAF, window: int = 64):
        self.t, self.leaf = t, leaf
        self.margin = 8 + max([len(a.content) for a in t.get_added_tokens_decoder().values()] or [0])
        self.window = max(window, 2 * self.margin)
        self.cut, self.table = specials_of(t), PieceTable(piece_coder(t)) if gpt2_pieces(t) else None
        self.joins = 0

    def _code(self, stretches: list[tuple[str, int, int]]) -> list[Node]:
        """Nodes of stretches of texts, each coded as if nothing stood around it."""
        if not self.table:
            found = (e for batch in batches([x[a:b] for x, a, b in stretches]) for e in self.t.encode_batch(batch, add_special_tokens=False))
            return [self._by_library(stretch, e) for stretch, e in zip(stretches, found, strict=True)]
        pieces = [parted(x[a:b], self.cut, BYTE_PIECE) for x, a, b in stretches]
        ids = iter(self.table([p for own in pieces for p in own]))
        return [Node(a, b, [*accumulate(map(len, own[:-1]), initial=a)] if own else [], [*islice(ids, len(own))]) for (_, a, b), own in zip(stretches, pieces, strict=True)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        leaves, counts = [], []
        for x in texts:
            n = 1
            while len(x) > n * self.leaf:
                n *= 2
            cuts = [len(x) * i // n for i in range(n + 1)]
            counts.append(n)
            leaves += [(x, a, b) for a, b in zip(cuts, cuts[1:])]  # noqa: B905
        coded = iter(self._code(leaves))
        levels = [[*islice(coded, n)] for n in counts]
        while any(len(level) > 1 for level in levels):
            pairs = [(i, j) for i, level in enumerate(levels) for j in range(0, len(level) - 1, 2)]
            joined = self._joined([(texts[i], levels[i][j], levels[i][j + 1]) for i, j in pairs])
            after: list[list] = [[] if len(level) > 1 else level for level in levels]
            for (i, _), node in zip(pairs, joined, strict=True):
                after[i].append(node)
            levels = after
        return [[k for ids in level[0].ids for k in ids] for level in levels]

    def _joined(self, pairs: list[tuple[str, Node, Node]]) -> list[Node]:
        """Nodes of neighbours; a window that does not agree yet is coded again at twice its width."""
        self.joins += len(pairs)
        done = [right if left.start == left.end else left if right.start == right.end else None for _, left, right in pairs]
        open_, width = [i for i, node in enumerate(done) if node is None], self.window
        while open_:
            kept, stretches = [], []
            for i in open_:
                text, left, right = pairs[i]
                kept.append(max(0, bisect_right(left.starts, left.end - width) - 1))
                stretches.append((text, left.starts[kept[-1]], min(right.end, right.start + width)))
            for i, k, window in zip(open_, kept, self._code(stretches), strict=True):
                done[i] = self._agreed(pairs[i][1], pairs[i][2], k, window)
            open_, width = [i for i in open_ if done[i] is None], 2 * width
        return done

    def _agreed(self, left: Node, right: Node, k: int, window: Node) -> Node | None:
        whole = window.end == right.end
        last = window.end - (0 if whole else self.margin)
        w, j = bisect_left(window.starts, right.start), len(right.starts)
        if not (whole and window.start == left.start):
            for w in range(w, len(window.starts)):
                place = window.starts[w]
                if place > last:
                    break
                at = bisect_left(right.starts, place)
                if at < len(right.starts) and right.starts[at] == place:
                    j = at
                    break
        if j == len(right.starts):
            if not whole:
                return None
            w = len(window.starts)  # no common place up to the end: all from the window's start on is the window's
        parts = [(left, 0, k), (window, 0, w), (right, j, len(right.starts))]
        return Node(left.start, right.end, [x for n, a, b in parts for x in n.starts[a:b]], [x for n, a, b in parts for x in n.ids[a:b]])

    @staticmethod
    def _by_library(stretch: tuple[str, int, int], e) -> Node:
        node, before = Node(*stretch[1:], [], []), None
        for token, word, (start, _) in zip(e.ids, e.word_ids, e.offsets, strict=True):
            if not node.ids or word != before:
                node.starts.append(stretch[1] + start)
                node.ids.append([])
            node.ids[-1].append(token)
            before = word
        return node


def byte_alphabet() -> dict[int, str]:
    """The characters that byte-level models write bytes as: printable Latin-1 ones as themselves, the others in order
    from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_ALPHABET = byte_alphabet()
_PLAIN = re.compile(rf" ?[{_LETTER}]+")


def encode_pieces(path: str, fold: bool = False) -> Callable[[list[str]], list[list[int]]]:
    return piece_coder(tokenizer(path), fold)


def piece_coder(t: Tokenizer, fold: bool = False) -> Callable[[list[str]], list[list[int]]]:
    """Ids of pieces. Runs of letters are one pre-token that nothing normalizes but case (fold), so that the model can
    take them at once; all others go through the tokenizer."""
    tokenize, plain = t.model.tokenize, _PLAIN.fullmatch

    def one(piece: str) -> list[int]:
        x = piece.lower() if fold else piece
        mapped = x.encode().decode("latin-1").translate(_ALPHABET)
        return [token.id for token in tokenize(mapped)]

    def code(batch: list[str]) -> list[list[int]]:
        out, rest = [], []
        for p in batch:
            if plain(p):
                out.append(one(p))
            else:
                rest.append(len(out))
                out.append(p)
        if rest:
            for i, e in zip(rest, t.encode_batch_fast([out[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    return code


@functools.lru_cache(maxsize=2)
def tree_encoder(path: str) -> TreeEncoder:
    return TreeEncoder(tokenizer(path))


def coded(texts: list[str], path: str) -> Iterator[list[list[int]]]:
    """For each text the ids of its slices between safe boundaries. Slices of several texts are coded together, up to
    about SLICE characters; a longer one, which has no safe boundary, alone."""
    tree = tree_encoder(path)
    held, size, owners = [], 0, []

    def flush() -> list[list[list[int]]]:
        ids = iter(tree.encode(held))
        return [[next(ids) for _ in range(n)] for n in owners]

    for x in texts:
        own = list(slices(x)) if x else []
        if held and size + len(x) > SLICE:
            yield from flush()
            held, size, owners = [], 0, []
        held, size, owners = held + own, size + len(x), [*owners, len(own)]
    yield from flush()


@functools.lru_cache(maxsize=2)
def tables(path: str) -> tuple[list[str], list[bytes]]:
    """For each id its decimal digits, and the bytes that a byte-level decoder gives it: its characters' bytes in the
    byte alphabet, or where one has none (in an added token) the token as it is."""
    t, byte = tokenizer(path), {c: b for b, c in _ALPHABET.items()}
    tokens = [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]
    plain = [bytes([byte[c] for c in x]) if all(c in byte for c in x) else x.encode() for x in tokens]
    return list(map(str, range(len(tokens)))), plain


def digests(ids: list[list[int]], path: str) -> tuple[int, bytes, bytes]:
    """Number of tokens, decimal ids joined by commas, and the decoded text in UTF-8, of a text's slices."""
    digits, plain = tables(path)
    listed = ",".join([digits[i] for x in ids for i in x]).encode()
    decoded = b"".join([plain[i] for x in ids for i in x])
    return sum(map(len, ids)), listed, decoded.decode("utf-8", "replace").encode()


def encode_decode(df: DataFrame, path: str, text: str = "text", full: bool = False) -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256 of every whole text; with full, also ids (array) and decoded.

    Null is taken as the empty text: no tokens and the digests of the empty string. Repeated rows are coded alike;
    extra columns stay; columns of df with the names of the new ones are replaced. An empty table gives an empty one.
    """
    short_batches(df.sparkSession)
    kind = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string" + (",ids:array<int>,decoded:string>" if full else ">")

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            n, a, b, ids, texts = [], [], [], [], []
            for own in coded(strings(batch), path):
                k, listed, decoded = digests(own, path)
                n.append(k)
                a.append(hashlib.sha256(listed).hexdigest())
                b.append(hashlib.sha256(decoded).hexdigest())
                if full:
                    ids.append([i for x in own for i in x])
                    texts.append(decoded.decode("utf-8", "replace"))
            cols = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.StructArray.from_arrays(cols, names)

    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if full else [])
    return with_struct(df, run(F.col(quoted(text))), names)
