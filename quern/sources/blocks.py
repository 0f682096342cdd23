"""Sources of structural blocks: Markdown, CSV, HTML, content lists and document trees.

Each parser is a plain function from one file's content to rows, applied to many files with mapInPandas. The common row:
index, content, block_type, page_no, title_path, line_start, line_end, parent_id, metadata (JSON).
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_DDL = (
    "index int, content string, block_type string, page_no int, title_path array<string>, line_start int, line_end int, "
    "parent_id string, metadata string"
)
#: Characters of a table block with its header.
TABLE_CHARS = 4000

_FENCE = re.compile(r"(`{3,}|~{3,})([^`]*)$")
_ITEM = re.compile(r"\s*([-+*]|\d+[.)])\s+")
_RULE_CELL = re.compile(r":?-{3,}:?")
_BREAK = re.compile(r"([*_-])(\s*\1){2,}\s*$")


def _cells(line: str) -> list[str]:
    inner = line.strip()
    inner = inner.removeprefix("|").removesuffix("|") if "|" in inner else ""
    return [c.strip() for c in inner.split("|")] if "|" in inner else []


def is_table(lines: list[str]) -> bool:
    """A header and a rule of as many cells, two or more."""
    if len(lines) < 2:
        return False
    head, rule = _cells(lines[0]), _cells(lines[1])
    return len(head) == len(rule) >= 2 and all(map(_RULE_CELL.fullmatch, rule))


def is_list(lines: list[str]) -> bool:
    """Items with indented, nested or lazy continuation lines, but no other block at the top level."""

    def goes_on(line: str) -> bool:
        bare = line.lstrip()
        other = bare[:1] in (">", "#") or _FENCE.match(bare) or _BREAK.match(bare)
        return bool(_ITEM.match(line)) or line[:1].isspace() or bool(bare and not other)

    return bool(lines) and bool(_ITEM.match(lines[0])) and all(map(goes_on, lines[1:]))


def is_quote(lines: list[str]) -> bool:
    """A quote, with lazy continuation."""
    return bool(lines) and lines[0].lstrip().startswith(">") and all(line.strip() for line in lines[1:])


def block_kind(content: str) -> tuple[str, dict]:
    """Type and metadata of a whole Markdown block."""
    lines = content.splitlines()
    fence = _FENCE.match(lines[0].strip()) if lines else None
    if fence:
        info = fence.group(2).split()
        return "CODE", {"language": info[0]} if info else {}
    for kind, test in (("TABLE", is_table), ("LIST", is_list), ("QUOTE", is_quote)):
        if test(lines):
            return kind, {}
    return "TEXT", {}


def _marked_lines(text: str) -> Iterator[tuple[int, str, tuple[str, ...], int]]:
    """(block number, line, title path, line number) of each line that belongs to a block."""
    path: tuple[str, ...] = ()
    block, fence, open_ = 0, None, False
    for number, line in enumerate(text.splitlines(), 1):
        bare = line.strip()
        if fence:
            yield block, line, path, number
            if bare.startswith(fence):
                fence, open_, block = None, False, block + 1
            continue
        if not bare or bare.startswith("#"):
            block, open_ = block + 1, False
            if bare:
                title = bare.lstrip("#").strip()
                depth = len(bare) - len(bare.lstrip("#"))
                path = (*path[: depth - 1], title) if title else path
            continue
        begins = _FENCE.match(bare)
        if open_ and not line[0].isspace() and (begins or bare[0] == ">"):
            block += 1
        open_ = True
        yield block, line, path, number
        if begins:
            fence = begins.group(1)


def markdown_blocks(text: str) -> list[dict]:
    """Blocks of a Markdown text. Headings give the title path and are no blocks; fences are whole."""
    out: list[dict] = []
    for _, group in groupby(_marked_lines(text), key=lambda m: m[0]):
        rows = list(group)
        content = "\n".join(r[1] for r in rows).strip()
        if not content:
            continue
        kind, metadata = block_kind(content)
        path = list(rows[0][2])
        out.append(_row(len(out), content, kind, 1, path, rows[0][3], rows[-1][3], "/".join(path) or None, metadata))
    return out


def _row(index: int, content: str, kind: str, page: int | None, path: list[str], low: int | None, high: int | None, parent: str | None, metadata: dict) -> dict:
    return {
        "index": index, "content": content, "block_type": kind, "page_no": page, "title_path": path, "line_start": low,
        "line_end": high, "parent_id": parent, "metadata": json.dumps(metadata, ensure_ascii=False, sort_keys=True),
    }


def blocks_to_markdown(blocks: list[dict]) -> str:
    """Blocks as Markdown, with headings where the title path changes."""
    parts, path = [], []
    for block in blocks:
        new = list(block["title_path"])
        same = next((i for i, (a, b) in enumerate(zip(path, new)) if a != b), min(len(path), len(new)))
        parts += [f"{'#' * (i + 1)} {new[i]}" for i in range(same, len(new))] if new != path else []
        parts.append(block["content"])
        path = new
    return "\n\n".join(parts)


def csv_rows(text: str) -> list[list[str]]:
    """Rows with any value, with the delimiter found from the beginning of the text."""
    try:
        dialect = csv.Sniffer().sniff(text[:8192], delimiters=",;\t|")
    except csv.Error:
        dialect = csv.excel
    return [r for r in csv.reader(io.StringIO(text), dialect) if any(c.strip() for c in r)]


def _table_line(cells: list[str], width: int) -> str:
    shown = [" ".join(c.split()).replace("|", r"\|") for c in cells[:width]]
    return f"| {' | '.join(shown + [''] * (width - len(shown)))} |"


def csv_blocks(text: str, limit: int = TABLE_CHARS) -> list[dict]:
    """Table blocks of as many rows as fit in `limit` characters, each with the header. The header is row 1."""
    rows = csv_rows(text.removeprefix("﻿"))
    if not rows:
        return []
    width = len(rows[0])
    head = [_table_line(rows[0], width), f"| {' | '.join(['---'] * width)} |"]
    room = limit - sum(map(len, head)) - 1  # line ends count
    packs: list[list[str]] = []
    used = 0
    for line in (_table_line(r, width) for r in rows[1:]):
        if not packs or used + len(line) + 1 > room:
            packs.append([])
            used = 0
        packs[-1].append(line)
        used += len(line) + 1
    out, at = [], 2
    for pack in packs:
        end = at + len(pack) - 1
        out.append(_row(len(out), "\n".join(head + pack), "TABLE", 1, [], at, end, None, {"header": rows[0]}))
        at = end + 1
    return out


#: Item types of content lists and labels of document trees.
LIST_TYPES = {"text": "TEXT", "table": "TABLE", "image": "IMAGE", "equation": "FORMULA", "code": "CODE", "list": "LIST"}
TREE_LABELS = {
    "paragraph": "TEXT", "text": "TEXT", "list_item": "LIST", "table": "TABLE", "picture": "IMAGE", "formula": "FORMULA",
    "code": "CODE", "caption": "TEXT", "footnote": "TEXT",
}
FURNITURE = ("page_header", "page_footer")


def content_list_blocks(text: str) -> list[dict]:
    """Blocks of a content list: text with a level is a heading; images without a caption are left out."""
    out, path = [], []
    for item in json.loads(text):
        level, body = item.get("text_level") or 0, (item.get("text") or "").strip()
        page = item.get("page_idx", 0) + 1
        if item.get("type") == "text" and level >= 1:
            path = [*path[: level - 1], body] if body else path
            continue
        captions = [c for c in (item.get("image_caption") or []) + (item.get("table_caption") or []) if c]
        content = "\n".join(filter(None, [*captions, item.get("table_body"), body]))
        if content:
            kind = LIST_TYPES.get(item.get("type"), "TEXT")
            out.append(_row(len(out), content, kind, page, list(path), None, None, "/".join(path) or None, {"bbox": item.get("bbox")} if item.get("bbox") else {}))
    return out


def tree_blocks(text: str) -> list[dict]:
    """Blocks of a document tree in reading order. Children are references; page headers and footers are left out."""
    tree, out, path = json.loads(text), [], []
    nodes = {f"#/{group}/{i}": node for group in ("texts", "tables", "pictures", "groups") for i, node in enumerate(tree.get(group, []))}
    stack = [c["$ref"] for c in reversed(tree.get("body", {}).get("children", []))]
    seen: set[str] = set()
    while stack:
        ref = stack.pop()
        node = nodes.get(ref)
        if node is None or ref in seen:
            continue
        seen.add(ref)
        stack += [c["$ref"] for c in reversed(node.get("children", []))]
        label = node.get("label", "")
        if label in FURNITURE:
            continue
        body = (node.get("text") or "").strip()
        if label in ("title", "section_header"):
            depth = 1 if label == "title" else node.get("level", 1) + 1
            path = [*path[: depth - 1], body] if body else path
            continue
        captions = [nodes[c["$ref"]].get("text", "") for c in node.get("captions", []) if c["$ref"] in nodes]
        grid = node.get("data", {}).get("grid") if isinstance(node.get("data"), dict) else None
        if grid:
            rows = [[c.get("text", "") for c in r] for r in grid]
            body = "\n".join([_table_line(rows[0], len(rows[0])), f"| {' | '.join(['---'] * len(rows[0]))} |", *(_table_line(r, len(rows[0])) for r in rows[1:])])
        content = "\n".join(filter(None, [*captions, body]))
        page = (node.get("prov") or [{}])[0].get("page_no")
        if content and label in TREE_LABELS:
            out.append(_row(len(out), content, TREE_LABELS[label], page, list(path), None, None, "/".join(path) or None, {}))
    return out


class _Page(HTMLParser):
    """Gathers a page's blocks: headings are the title path, tables become Markdown rows, lists their items."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, list[str]]] = []
        self.path: list[str] = []
        self.kind, self.parts, self.hidden, self.rows = "TEXT", [], 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")
        if tag in ("p", "div", "li", "pre", "blockquote", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6") and self.kind != "TABLE":
            self.close_block()
            self.kind = {"li": "LIST", "pre": "CODE", "blockquote": "QUOTE", "table": "TABLE"}.get(tag, "TEXT")
        if tag == "tr":
            self.rows.append([])
        if tag in ("td", "th"):
            self.parts = []

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head") and self.hidden > 0
        text = " ".join("".join(self.parts).split())
        if tag in ("td", "th") and self.rows:
            self.rows[-1].append(text)
            self.parts = []
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.path, self.parts = [*self.path[: int(tag[1]) - 1], *([text] if text else [])], []
        elif tag in ("p", "div", "li", "pre", "blockquote", "table"):
            self.close_block()

    def close_block(self):
        if self.kind == "TABLE" and any(self.rows):
            rows = [r for r in self.rows if r]
            width = len(rows[0])
            text = "\n".join([_table_line(rows[0], width), f"| {' | '.join(['---'] * width)} |", *(_table_line(r, width) for r in rows[1:])])
        else:
            raw = "".join(self.parts)
            text = raw.strip("\n") if self.kind == "CODE" else " ".join(raw.split())
            text = f"- {text}" if text and self.kind == "LIST" else text
        if text.strip():
            self.blocks.append((self.kind, text, list(self.path)))
        self.kind, self.parts, self.rows = "TEXT", [], []


def html_blocks(text: str) -> list[dict]:
    """Blocks of an HTML page. Neighbouring items of a list are one block; scripts, styles and the head are left out."""
    page = _Page()
    page.feed(text)
    page.close()
    page.close_block()
    out = []
    for (kind, path), group in groupby(page.blocks, key=lambda b: (b[0] if b[0] == "LIST" else id(b), b[2])):
        rows = list(group)
        out.append(_row(len(out), "\n".join(r[1] for r in rows), rows[0][0], 1, path, None, None, "/".join(path) or None, {}))
    return out


PARSERS: dict[str, Callable[[str], list[dict]]] = {
    "md": markdown_blocks, "markdown": markdown_blocks, "txt": markdown_blocks, "csv": csv_blocks, "list.json": content_list_blocks, "tree.json": tree_blocks,
    "html": html_blocks, "htm": html_blocks,
}
#: Media types that stand for a suffix where a name has none that is known.
MEDIA_TYPES = {"text/markdown": "md", "text/plain": "txt", "text/csv": "csv", "text/html": "html"}


def parser_for(name: str, media_type: str | None = None, allowed: frozenset[str] | None = None) -> Callable[[str], list[dict]] | None:
    """The parser of a file by its longest known suffix, or else by its media type. `allowed` limits the suffixes; those
    that no parser supports are of no use in it."""
    usable = {s: p for s, p in PARSERS.items() if allowed is None or s in allowed}
    found = [s for s in usable if name.lower().endswith(f".{s}")]
    suffix = max(found, key=len) if found else MEDIA_TYPES.get((media_type or "").split(";")[0].strip().lower())
    return usable.get(suffix)


def parse_files(files: DataFrame, allowed: frozenset[str] | None = None) -> DataFrame:
    """Blocks of every file (id, name, content, and media_type if there is one), with id. Content is text, or bytes that
    must be UTF-8. Files of unknown or other than allowed type, or of broken content, give one row with an error and no
    block."""

    names = [c.split()[0] for c in BLOCK_DDL.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[dict] = []
            for id_, name, media_type, content in zip(frame["id"], frame["name"], frame["media_type"], frame["content"], strict=True):
                parser = parser_for(name or "", media_type, allowed)
                try:
                    if parser is None:
                        raise ValueError("UNSUPPORTED")
                    if isinstance(content, (bytes, bytearray)):
                        content = bytes(content).decode("utf-8", "strict")
                    rows += [{"id": id_, "error": None, **b} for b in parser(content or "")]
                except (ValueError, KeyError, TypeError, AttributeError) as error:
                    known = "UNSUPPORTED" if parser is None else f"BROKEN: {type(error).__name__}"
                    rows.append({"id": id_, "error": known, **dict.fromkeys(names)})
            yield pd.DataFrame(rows, columns=["id", "error", *names], dtype=object)

    kind = dict(files.dtypes)["id"]
    media_type = F.col("media_type") if "media_type" in files.columns else F.lit(None).cast("string").alias("media_type")
    return files.select("id", "name", media_type, "content").mapInPandas(run, f"id {kind}, error string, {BLOCK_DDL}")
