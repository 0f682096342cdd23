"""Blocks to a hierarchy of bounded chunks: one document is one group, folded in Python because each cut depends on the last."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.config import ChunkPolicy
from quern.operators.handlers import HANDLERS, Context, Handler, Places, Remembered, handled, prefix_within, word_counter

__all__ = ["HANDLERS", "Handler", "chunk_document", "chunk_documents", "chunking_warnings", "count_tokens", "prefix_within"]

#: Where a long text may be cut, coarsest first.
LEVELS = (
    ("structure", re.compile(r"\n(?=\s*(?:#|[-+*]\s|\d+[.)]\s|>))")), ("paragraph", re.compile(r"\n\s*\n")), ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"(?<=[.!?。！？])\s*")), ("punctuation", re.compile(r"(?<=[,;:，；：])\s*")), ("word", re.compile(r"(?<=\s)")),
)
PROSE = ("TEXT", "QUOTE")

Counter = Callable[[str], int]


#: The default counter.
count_tokens = word_counter()


@dataclass
class Piece:
    """A part of a chunk's making."""

    content: str
    kind: str
    path: tuple[str, ...]
    blocks: list[int]
    pages: list[int]
    level: str = ""
    prefix: str = ""
    metadata: dict = field(default_factory=dict)

    def text(self) -> str:
        return f"{self.prefix}\n\n{self.content}" if self.prefix else self.content


def _ends(places: Places, low: int, high: int, pattern: re.Pattern) -> list[int]:
    """Where a part of a text may be cut."""
    part = places.text[low:high]
    return sorted({low + m.end() for m in pattern.finditer(part) if 0 < m.end() < len(part)})


def split_text(text: str, policy: ChunkPolicy, count: Counter) -> list[tuple[str, str]]:
    """(level, part) of a text over the maximum, cut at the coarsest level that makes its largest span smaller and packed
    to the target. The parts joined are the text."""
    return [(level, text[low:high]) for level, low, high in _split(Places(text, count), 0, len(text), policy)]


def _split(places: Places, start: int, end: int, policy: ChunkPolicy) -> list[tuple[str, int, int]]:
    whole = places.tokens(start, end)
    if whole <= policy.max_tokens:
        return [("", start, end)]
    for level, pattern in LEVELS:
        edges = [start, *_ends(places, start, end, pattern), end]
        sizes = [places.tokens(low, high) for low, high in zip(edges, edges[1:])]
        if len(sizes) < 2 or max(sizes) >= whole:
            continue
        packed: list[tuple[int, int]] = []
        bound = 0  # at least the last part's tokens: joined texts never have more tokens than their parts
        for low, high, size in zip(edges, edges[1:], sizes):
            more = bound + size
            if packed and more > policy.target_tokens:
                joined = places.tokens(packed[-1][0], high)
                fits = joined <= policy.target_tokens or (joined <= policy.max_tokens and places.tokens(*packed[-1]) < policy.min_tokens)
                more = joined
            else:
                fits = bool(packed)
            if fits:
                packed[-1] = packed[-1][0], high
                bound = more
            else:
                packed.append((low, high))
                bound = size
        if len(packed) > 1:
            return _balanced([(deeper or level, low, high) for p in packed for deeper, low, high in _split(places, *p, policy)], places, policy)
    return [("hard", low, high) for low, high in places.cuts(start, end, policy.max_tokens)]


def _balanced(parts: list[tuple[str, int, int]], places: Places, policy: ChunkPolicy) -> list[tuple[str, int, int]]:
    if len(parts) < 2 or places.tokens(*parts[-1][1:]) >= policy.min_tokens:
        return parts
    start, end = parts[-2][1], parts[-1][2]
    within = lambda low, high: policy.min_tokens <= places.tokens(low, high) <= policy.max_tokens
    for level, pattern in LEVELS:
        fits = [e for e in _ends(places, start, end, pattern) if within(start, e) and within(e, end)]
        if fits:
            cut = min(fits, key=lambda e: (abs(places.tokens(start, e) - policy.target_tokens), e))
            return [*parts[:-2], (level, start, cut), (level, cut, end)]
    return parts


def balanced_tail(parts: list[tuple[str, str]], policy: ChunkPolicy, count: Counter) -> list[tuple[str, str]]:
    """The parts, with the last boundary moved where the last part is under the minimum: to the coarsest place that leaves
    both sides within the bounds, of several to that which brings the left one nearest to the target."""
    if len(parts) < 2:
        return parts
    (level, left), (last, right) = parts[-2:]
    joined = left + right
    moved = _balanced([(level, 0, len(left)), (last, len(left), len(joined))], Places(joined, count), policy)
    return [*parts[:-2], *((name, joined[low:high]) for name, low, high in moved)]


def _render(a: Piece, b: Piece) -> Piece:
    """Two neighbours as one: lists joined by a line end, others by a blank line; of two types TEXT."""
    joiner = "\n" if a.kind == b.kind == "LIST" else "\n\n"
    return Piece(f"{a.content}{joiner}{b.content}", a.kind if a.kind == b.kind else "TEXT", a.path, a.blocks + b.blocks, a.pages + b.pages)


def merge_small(pieces: list[Piece], policy: ChunkPolicy, count: Counter, warnings: list[str] | None = None) -> list[Piece]:
    """Prose under the minimum joins the next prose of its section while the maximum holds; else the one before; else it
    stays, with a warning. What is not prose, or of another section, ends a run."""
    out: list[Piece] = []
    run: list[Piece] = []  # emitted pieces of the present run
    held: Piece | None = None

    def emit(piece: Piece) -> None:
        if count(piece.content) < policy.min_tokens:
            if run and count(_render(run[-1], piece).content) <= policy.max_tokens:
                run[-1] = _render(run[-1], piece)
                return
            if warnings is not None:
                warnings.append(f"TINY:{piece.blocks[0]}")
        run.append(piece)

    def close() -> None:
        nonlocal held
        if held is not None:
            emit(held)
        held = None
        out.extend(run)
        run.clear()

    for piece in pieces:
        if piece.kind not in PROSE:
            close()
            out.append(piece)
        elif held is None or held.path != piece.path:
            close()
            held = piece
        elif count(held.content) < policy.min_tokens and count(_render(held, piece).content) <= policy.max_tokens:
            held = _render(held, piece)
        else:
            emit(held)
            held = piece
    close()
    return out


def overlap_prefix(text: str, limit: int, count: Counter) -> str:
    """The longest run of whole sentences at the end of a text within the limit, or else of characters."""
    sentences = [s for s in re.split(r"(?<=[.!?。！？])\s+", text) if s]
    held = ""
    for sentence in reversed(sentences):
        joined = f"{sentence} {held}".strip()
        if count(joined) > limit:
            break
        held = joined
    if held:
        return held
    places, low = Places(text, count), len(text)
    while low and places.tokens(low - 1, len(text)) <= limit:
        low -= 1
    return text[low:].strip()


def _normalized(blocks: list[dict], warnings: list[str]) -> list[Piece]:
    """Blocks in order of their index, which must be unique and not negative; empty ones are left out with a warning."""
    indexes = [b["index"] for b in blocks]
    if len(set(indexes)) < len(indexes) or any(i is None or i < 0 for i in indexes):
        raise ValueError("block indexes must be unique and not negative")
    out = []
    for b in sorted(blocks, key=lambda b: b["index"]):
        text = (b["content"] or "").replace("\r\n", "\n").replace("\r", "\n").strip()
        kind = "TEXT" if b["block_type"] in (None, "UNKNOWN") else b["block_type"]
        if not text and kind != "IMAGE":
            warnings.append(f"EMPTY:{b['index']}")
            continue
        path = tuple(b["title_path"] if b["title_path"] is not None else ())
        pages = [b["page_no"]] if b["page_no"] is not None else []
        out.append(Piece(text, kind, path, [b["index"]], pages, metadata=json.loads(b.get("metadata") or "{}")))
    return out


def chunk_document(
    blocks: list[dict], policy: ChunkPolicy, count: Counter = count_tokens, handlers: dict[str, Handler] | None = None, warnings: list[str] | None = None
) -> list[dict]:
    """Parents and children of one document's blocks (index, content, block_type, page_no, title_path, metadata).

    Every child has at most the maximum of tokens, prefix included. A child's `content` without its first
    `prefix_chars` characters is its own text. Parents are runs of one section within the parent maximum, of the
    children's own texts. Types with a handler are cut by it, others as prose; an image that nothing is known of gives no
    chunk. Warnings are TINY, EMPTY and SKIPPED with a block's index.
    """
    told: list[str] = [] if warnings is None else warnings
    typed, count = handlers or HANDLERS, Remembered(count)
    pieces = merge_small(_normalized(blocks, told), policy, count, told)
    children: list[Piece] = []
    for number, piece in enumerate(pieces):
        if piece.kind in typed:
            near = [pieces[k].content if 0 <= k < len(pieces) and pieces[k].kind in PROSE and pieces[k].path == piece.path else "" for k in (number - 1, number + 1)]
            parts = handled(piece.kind, piece.content, policy, count, Context(piece.path, piece.metadata, *near), typed)
            if not parts:
                told.append(f"SKIPPED:{piece.blocks[0]}")
            children += [Piece(content, piece.kind, piece.path, piece.blocks, piece.pages, metadata=more) for content, more in parts]
            continue
        parts = [p for p in split_text(piece.content, policy, count) if p[1].strip()]
        for i, (level, part) in enumerate(parts):
            child = Piece(part.strip(), piece.kind, piece.path, piece.blocks, piece.pages, level)
            if i and piece.kind == "TEXT" and level in ("sentence", "punctuation", "word", "hard") and policy.overlap_tokens:
                prefix = overlap_prefix(children[-1].content, policy.overlap_tokens, count)
                if prefix and count(f"{prefix}\n\n{child.content}") <= policy.max_tokens:
                    child.prefix = prefix
            children.append(child)
    rows, parents = [], []
    for i, child in enumerate(children):
        own = count(child.content)
        if not parents or parents[-1]["path"] != child.path or parents[-1]["tokens"] + own > policy.parent_max_tokens:
            parents.append({"path": child.path, "tokens": 0, "parts": [], "pages": [], "kinds": set(), "blocks": []})
        parent = parents[-1]
        parent["tokens"] += own
        parent["parts"].append(child.content)
        parent["pages"] += child.pages
        parent["kinds"].add(child.kind)
        parent["blocks"] += child.blocks
        text = child.text()
        rows.append(_chunk("CHILD", i, len(parents) - 1, text, child, count(text), len(text) - len(child.content)))
    for i, p in enumerate(parents):
        text = "\n\n".join(p["parts"])
        kind = p["kinds"].pop() if len(p["kinds"]) == 1 else "TEXT"
        rows.append(_chunk("PARENT", i, None, text, Piece(text, kind, p["path"], p["blocks"], p["pages"]), count(text), 0))
    return rows


CHUNK_DDL = (
    "chunk_level string, chunk_index int, parent_index int, content string, block_type string, title_path array<string>, "
    "token_count int, page_start int, page_end int, block_indexes array<int>, prefix_chars int, split_level string, metadata string"
)


def _chunk(level: str, index: int, parent: int | None, content: str, piece: Piece, tokens: int, prefix: int) -> dict:
    return {
        "chunk_level": level, "chunk_index": index, "parent_index": parent, "content": content, "block_type": piece.kind, "title_path": list(piece.path),
        "token_count": tokens, "page_start": min(piece.pages, default=None), "page_end": max(piece.pages, default=None),
        "block_indexes": list(dict.fromkeys(piece.blocks)), "prefix_chars": prefix, "split_level": piece.level,
        "metadata": json.dumps(piece.metadata, ensure_ascii=False, sort_keys=True),
    }


def _picked(blocks: DataFrame) -> DataFrame:
    more = F.col("metadata") if "metadata" in blocks.columns else F.lit(None).cast("string").alias("metadata")
    return blocks.select("id", "index", "content", "block_type", "page_no", "title_path", more)


def _each_document(blocks: DataFrame, fold: Callable[[list[dict]], list[dict]], ddl: str) -> DataFrame:
    """What fold makes of each document's blocks, with id. Blocks are dealt by document and read in order; a task holds one
    document's blocks, and many documents share a batch."""
    kinds = [column.split() for column in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
        held: list[dict] = []

        def made(documents: list[list[dict]], id_type: pa.DataType) -> pa.RecordBatch:
            rows = [{"id": rows[0]["id"], **row} for rows in documents for row in fold(rows)]
            return pa.RecordBatch.from_pylist(rows, pa.schema([("id", id_type), *((name, types[kind]) for name, kind in kinds)]))

        id_type = pa.null()
        for batch in batches:
            id_type = batch.schema.field("id").type
            groups = [list(rows) for _, rows in groupby(batch.to_pylist(), key=lambda row: row["id"])]
            if held and groups and groups[0][0]["id"] == held[0]["id"]:
                held += groups.pop(0)
            if groups:
                done, held = [held, *groups[:-1]] if held else groups[:-1], groups[-1]
                yield made(done, id_type)
        if held:
            yield made([held], id_type)

    kind = dict(blocks.dtypes)["id"]
    dealt = _picked(blocks).repartition("id").sortWithinPartitions("id", "index")
    return dealt.mapInArrow(run, f"id {kind}, {ddl}")


def chunk_documents(blocks: DataFrame, policy: ChunkPolicy | None = None, count: Counter = count_tokens, handlers: dict[str, Handler] | None = None) -> DataFrame:
    """Chunks of every document: blocks has id and the columns of a block. A group is one document's blocks."""
    bounds = policy or ChunkPolicy()
    return _each_document(blocks, lambda rows: chunk_document(rows, bounds, count, handlers), CHUNK_DDL)


def chunking_warnings(blocks: DataFrame, policy: ChunkPolicy | None = None, count: Counter = count_tokens) -> DataFrame:
    """id, code and block index of each warning."""
    bounds = policy or ChunkPolicy()

    def fold(rows: list[dict]) -> list[dict]:
        told: list[str] = []
        chunk_document(rows, bounds, count, warnings=told)
        return [{"code": code, "index": int(at)} for code, at in (w.split(":") for w in told)]

    return _each_document(blocks, fold, "code string, index int")
