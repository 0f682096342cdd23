"""How blocks of each type are cut to a token bound: small functions from one block to its parts, by type.

A part is (content, metadata). A handler never returns a part over the maximum; where nothing else helps it cuts the text
at the last place that fits.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from quern.config import ChunkPolicy

Counter = Callable[[str], int]
Part = tuple[str, dict]


@dataclass
class Context:
    """What a handler may look at besides the block's text."""

    path: tuple[str, ...] = ()
    metadata: dict = field(default_factory=dict)
    before: str = ""
    after: str = ""


class Places:
    """Token counts of any part of one text. Where the counter tells a text's tokens by place, they are found once, and a part
    has those that it overlaps; other counters count each part."""

    def __init__(self, text: str, count: Counter):
        self.text, self.count = text, count
        self.places: tuple[list[int], list[int]] | None = None
        self.tells = getattr(count, "places", None)

    def tokens(self, low: int, high: int) -> int:
        if low == 0 and high == len(self.text) and self.places is None:
            return self.count(self.text)
        if self.tells and self.places is None:
            self.places = self.tells(self.text)
            self.tells = self.tells if self.places else None
        if not self.places:
            return self.count(self.text[low:high])
        return bisect_left(self.places[0], high) - bisect_right(self.places[1], low) if low < high else 0

    def prefix(self, low: int, high: int, limit: int) -> int:
        """End of a part from low on of at most `limit` tokens, nearly the longest, at least one character.

        Counts need not rise with the length, as those of byte pairs don't: what the search finds is checked and shortened
        until it fits.
        """
        least, most = low + 1, high
        while least < most:
            middle = (least + most + 1) // 2
            if self.tokens(low, middle) <= limit:
                least = middle
            else:
                most = middle - 1
        while least > low + 1 and self.tokens(low, least) > limit:
            least -= 1
        return least

    def cuts(self, low: int, high: int, limit: int) -> Iterator[tuple[int, int]]:
        """A part in nearly longest parts of at most `limit` tokens."""
        while low < high:
            cut = high if self.tokens(low, high) <= limit else self.prefix(low, high, limit)
            yield low, cut
            low = cut


def prefix_within(text: str, limit: int, count: Counter) -> int:
    """Length of a beginning of at most `limit` tokens, nearly the longest, at least one character."""
    return Places(text, count).prefix(0, len(text), limit)


def hard_cut(text: str, limit: int, count: Counter) -> Iterator[str]:
    """The text in nearly longest parts of at most `limit` tokens."""
    return (text[low:high] for low, high in Places(text, count).cuts(0, len(text), limit))


_TOKEN = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
_loaded: dict[str, object] = {}


@dataclass(frozen=True)
class TokenCounter:
    """A named way to count tokens. It is called as a function, in the workers too."""

    name: str
    version: str
    vocabulary: str | None = None

    def __call__(self, text: str) -> int:
        if self.vocabulary is None:
            return len(_TOKEN.findall(text))
        if self.vocabulary not in _loaded:
            from tokenizers import Tokenizer

            _loaded[self.vocabulary] = Tokenizer.from_file(self.vocabulary)
        return len(_loaded[self.vocabulary].encode(text, add_special_tokens=False).ids)

    def places(self, text: str) -> tuple[list[int], list[int]] | None:
        """Where the tokens of a text begin and end, if a part of the text has the tokens that it overlaps, whole or not."""
        if self.vocabulary is not None:
            return None
        found = [m.span() for m in _TOKEN.finditer(text)]
        return [low for low, _ in found], [high for _, high in found]

    def split(self, text: str, limit: int) -> list[str]:
        """The text in nearly longest parts of at most `limit` tokens; joined they are the text."""
        return list(hard_cut(text, limit, self))


class Remembered:
    """A counter that knows the counts of the last few texts: those of one chunk are asked for again and again."""

    def __init__(self, count: Counter, most: int = 16):
        self.count, self.most, self.known = count, most, {}

    def __call__(self, text: str) -> int:
        found = self.known.get(text)
        if found is None:
            if len(self.known) >= self.most:
                del self.known[next(iter(self.known))]
            found = self.known[text] = self.count(text)
        return found

    def __getattr__(self, name: str):
        return getattr(self.count, name)


def word_counter() -> TokenCounter:
    """Runs of letters and digits, and single ideographs."""
    return TokenCounter("words", "1")


def byte_pair_counter(vocabulary: str) -> TokenCounter:
    """Tokens of a byte-pair vocabulary, a file that every worker can read; it is loaded once in each."""
    return TokenCounter("byte-pairs", vocabulary.rsplit("/", 1)[-1], vocabulary)


def _affordable(wrap: Callable[[str], str], policy: ChunkPolicy, count: Counter) -> Callable[[str], str]:
    """wrap, or nothing around a part where that alone would take over half of the maximum."""
    return wrap if count(wrap("")) <= policy.max_tokens // 2 else lambda body: body


def packed(units: list[str], wrap: Callable[[str], str], joiner: str, limit: int, most: int, count: Counter) -> Iterator[tuple[int, int, str]]:
    """(first, last, body) of runs of units: as many as fit in `limit` tokens when wrapped. A unit alone may take `most`;
    one that doesn't fit in that is cut, and each of its parts is a run of its own."""
    begin, body = 0, None
    for i, unit in enumerate(units):
        joined = unit if body is None else f"{body}{joiner}{unit}"
        if body is not None and count(wrap(joined)) <= limit:
            body = joined
            continue
        if body is not None:
            yield begin, i - 1, body
        begin, body = i, unit
        if count(wrap(unit)) > most:
            room = max(1, most - count(wrap("")))
            for part in hard_cut(unit, room, count):
                yield i, i, part
            begin, body = i + 1, None
    if body is not None:
        yield begin, len(units) - 1, body


_RULE = re.compile(r"[|\s:-]*-{3,}[|\s:-]*")


def _cells(line: str) -> list[str]:
    return [c.strip() for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]


def _line(cells: list[str]) -> str:
    return f"| {' | '.join(cells)} |"


def table(text: str, policy: ChunkPolicy, count: Counter, context: Context) -> list[Part]:
    """Groups of rows, each behind the caption and the header; groups of columns where one row doesn't fit; parts of a cell
    where one cell doesn't. Metadata: rows (first, last, the header being row 1) and columns."""
    lines = text.split("\n")
    rule = next((i for i, line in enumerate(lines) if i and _RULE.fullmatch(line)), None)
    if rule is None:
        return [(part, {}) for part in hard_cut(text, policy.max_tokens, count)]
    head, rows = lines[: rule + 1], lines[rule + 1 :]
    first = int(context.metadata.get("rowStart", 2))
    if not rows or count(text) <= policy.max_tokens:
        return [(text, {"rows": [first, first + max(0, len(rows) - 1)]})]
    wrap = lambda body: "\n".join([*head, body])
    out: list[Part] = []
    group: list[str] = []

    def close(end: int) -> None:
        if group:
            out.append((wrap("\n".join(group)), {"rows": [first + end - len(group), first + end - 1]}))
            group.clear()

    for i, row in enumerate(rows):
        if count(wrap(row)) > policy.max_tokens:
            close(i)
            out += [(part, {"rows": [first + i, first + i], **more}) for part, more in _wide_row(head, row, policy, count)]
            continue
        if group and count(wrap("\n".join([*group, row]))) > policy.target_tokens:
            close(i)
        group.append(row)
    close(len(rows))
    return out


def _wide_row(head: list[str], row: str, policy: ChunkPolicy, count: Counter) -> Iterator[Part]:
    names, cells, caption = _cells(head[-2]), _cells(row), head[:-2]
    shown = lambda low, high: "\n".join([*caption, _line(names[low:high]), _line(["---"] * (high - low)), _line(cells[low:high])])
    low = 0
    while low < len(cells):
        high = low + 1
        while high < len(cells) and count(shown(low, high + 1)) <= policy.max_tokens:
            high += 1
        if count(shown(low, high)) <= policy.max_tokens:
            yield shown(low, high), {"columns": [low, high - 1]}
        else:
            name = names[low] if low < len(names) else ""
            room = policy.max_tokens - count(f"{name}: ")
            for part in hard_cut(cells[low], max(1, room), count):
                yield f"{name}: {part}" if room > 0 else part, {"columns": [low, low]}
        low = high


_FENCE = re.compile(r"(`{3,}|~{3,})[^\n]*\n")


def code(text: str, policy: ChunkPolicy, count: Counter, context: Context) -> list[Part]:
    """Symbols and the gaps between them where the metadata names symbols by lines, else runs of lines, each within the
    block's fences. Metadata: lines (first, last, from 1), reason and signature."""
    opened = _FENCE.match(text)
    start = opened.group(0) if opened else ""
    body = text[len(start) :]
    end = f"\n{opened.group(1)}" if opened else ""
    body = body.removesuffix(opened.group(1)).removesuffix("\n") if opened else body
    lines = body.split("\n")
    wrap = _affordable(lambda part: f"{start}{part}{end}", policy, count)
    symbols = [s for s in context.metadata.get("symbols", []) if 1 <= s.get("lineStart", 0) <= s.get("lineEnd", 0) <= len(lines)]
    if count(text) <= policy.max_tokens and not symbols:
        return [(text, {"lines": [1, len(lines)]})]
    spans, at = [], 1
    for s in sorted(symbols, key=lambda s: s["lineStart"]):
        if s["lineStart"] < at:
            continue  # overlaps one before
        if s["lineStart"] > at:
            spans.append((at, s["lineStart"] - 1, {"reason": "symbol_gap"}))
        spans.append((s["lineStart"], s["lineEnd"], {"reason": "symbol", "signature": s.get("signature", "")}))
        at = s["lineEnd"] + 1
    if at <= len(lines):
        spans.append((at, len(lines), {"reason": "symbol_gap" if symbols else "lines"}))
    out: list[Part] = []
    for low, high, more in spans:
        part = "\n".join(lines[low - 1 : high])
        if not part.strip():
            continue
        if count(wrap(part)) <= policy.max_tokens and symbols:
            out.append((wrap(part), {"lines": [low, high], **more}))
        else:
            for i, j, run in packed(lines[low - 1 : high], wrap, "\n", policy.target_tokens, policy.max_tokens, count):
                if run.strip():
                    out.append((wrap(run), {"lines": [low + i, low + j], **more}))
    return out


def image(text: str, policy: ChunkPolicy, count: Counter, context: Context) -> list[Part]:
    """Section, caption, text read from the image, alternative text and what stands around it, each once. Nothing known:
    no part."""
    known = context.metadata
    lines, seen = [], set()
    for label, value in (
        ("Caption", known.get("caption") or text), ("OCR", known.get("ocr")), ("Alt", known.get("alt")), ("Context", context.before), ("Context", context.after),
    ):
        flat = " ".join((value or "").split())
        if flat and flat.casefold() not in seen:
            seen.add(flat.casefold())
            lines.append(f"{label}: {flat}")
    if not any(not line.startswith("Context") for line in lines):
        return []
    section = f"Section: {' / '.join(context.path)}" if context.path else ""
    wrap = (lambda body: f"{section}\n{body}") if section and count(section) < policy.max_tokens // 2 else lambda body: body
    return [(wrap(body), {}) for _, _, body in packed(lines, wrap, "\n", policy.target_tokens, policy.max_tokens, count)]


_ENVIRONMENT = re.compile(r"(?s)\s*(\\begin\{([^}]+)\})(.*)(\\end\{\2\})\s*\Z")


def formula(text: str, policy: ChunkPolicy, count: Counter, context: Context) -> list[Part]:
    """The source with what explains it. A long one is cut at its line ends, each part within the environment."""
    explained = " ".join((context.metadata.get("explanation") or context.before or "").split())
    whole = f"{text}\n\n{explained}" if explained else text
    if count(whole) <= policy.max_tokens:
        return [(whole, {})]
    if count(text) <= policy.max_tokens:
        return [(text, {}), *((part, {"reason": "explanation"}) for part in hard_cut(explained, policy.max_tokens, count))]
    found = _ENVIRONMENT.match(text)
    begin, inner, end = (found.group(1), found.group(3), found.group(4)) if found else ("", text, "")
    wrap = _affordable(lambda body: f"{begin}\n{body.strip()}\n{end}" if begin else body.strip(), policy, count)
    rows = [r for r in re.split(r"(?<=\\\\)\s*\n?", inner) if r.strip()]
    return [(wrap(body), {"reason": "rows"}) for _, _, body in packed(rows, wrap, "\n", policy.target_tokens, policy.max_tokens, count) if body.strip()]


_ITEM = re.compile(r"\s*(?:[-+*]|\d+[.)])\s+")


def items(text: str, policy: ChunkPolicy, count: Counter, context: Context) -> list[Part]:
    """Whole items behind the list's introduction; an item that doesn't fit is cut. Metadata: items (first, last, from 0)."""
    lines = text.split("\n")
    first = next((i for i, line in enumerate(lines) if _ITEM.match(line)), len(lines))
    intro, units = "\n".join(lines[:first]).strip(), []
    for line in lines[first:]:
        if _ITEM.match(line) and (not units or not line[0].isspace()):
            units.append(line)
        elif units:
            units[-1] += f"\n{line}"
    if count(text) <= policy.max_tokens or not units:
        return [(part, {}) for part in hard_cut(text, policy.max_tokens, count)]
    repeated = intro and count(intro) <= policy.max_tokens // 2
    wrap = (lambda body: f"{intro}\n{body}") if repeated else lambda body: body
    out: list[Part] = [] if repeated or not intro else [(part, {}) for part in hard_cut(intro, policy.max_tokens, count)]
    return out + [(wrap(body), {"items": [i, j]}) for i, j, body in packed(units, wrap, "\n", policy.target_tokens, policy.max_tokens, count)]


Handler = Callable[[str, ChunkPolicy, Counter, Context], list[Part]]
#: The handler of each type; a deployment may put its own in place of one, or of a new type.
HANDLERS: dict[str, Handler] = {"TABLE": table, "CODE": code, "IMAGE": image, "FORMULA": formula, "LIST": items}


def handled(kind: str, text: str, policy: ChunkPolicy, count: Counter, context: Context, handlers: dict[str, Handler] | None = None) -> list[Part]:
    """The parts of a block by its type's handler, checked: none is empty or over the maximum."""
    parts = (handlers or HANDLERS)[kind](text, policy, count, context)
    for content, _ in parts:
        if not content.strip() or count(content) > policy.max_tokens:
            raise ValueError(f"the handler of {kind} made a part that is empty or too long")
    return parts
