"""Tokenizers compiled to deterministic finite-state transducers and run over whole batches at once.

Two transducers in cascade give a text's tokens:

1. The splitter reads classes of code points and marks where pre-tokens begin. Its states are few, so a text is cut
   into chunks, each chunk becomes a map from every entry state to its exit state, and a parallel prefix scan composes
   the maps; then every chunk knows its entry state and all chunks are marked at once.
2. The merger reads the bytes of a pre-token. Its state holds, for each suffix of what was read that a vocabulary entry
   could still extend, the last token of the text before that suffix and the number of tokens there. That is all that
   later bytes can depend on, since a byte-pair encoding is the one token sequence whose neighbours all stay apart when
   encoded as pairs. Each transition carries the change in the number of tokens, so counts add up along the path.
   States and transitions are made when first met and kept for later batches; a full table starts again. A bounded
   merger makes only those that one batch meets several times and keeps them when it is full: learning a state costs
   far more than reading it, and most words of a large corpus are rare. Pre-tokens that leave its table are encoded by
   the library, each distinct one of a batch once.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np

#: Code points in a chunk, and how many of them are read from all entry states before a chunk counts as unsettled.
CHUNK, SETTLE = 256, 24
#: Code points taken in one run; a longer text is cut at a space between two characters other than white space.
PIECE = 1 << 21
_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")
#: States kept before the table starts again, and columns of the table, which distinct bytes take as they are met.
MAX_STATES, COLUMNS = 160_000, 128
#: In a bounded merger: how often a batch meets a transition that is made.
OFTEN = 2
#: What may follow an apostrophe in a contraction of its own.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

_LETTER, _NUMBER, _OTHER, _SPACE, _BLANK, _SHORT, _LONG, _SPACE_MORE, _BLANK_MORE, _PAD = range(10)
_START, _IN_LETTERS, _IN_NUMBERS, _IN_OTHERS, _AFTER_SPACE, _IN_SPACE, _ONE_LEFT, _TWO_LEFT = range(8)
_CONTINUES, _BEGINS, _DROPS = range(3)


#: The planes that have characters. Code points of others are no letters, numbers or spaces.
PLANES = (0, 1, 2, 3, 14)


def _alphabet() -> Iterator[str]:
    """The code points of PLANES but surrogates, in order, a part at a time."""
    for plane in PLANES:
        for low in range(plane << 16, plane + 1 << 16, 1 << 15):
            yield "".join(map(chr, (c for c in range(low, low + (1 << 15)) if not 0xD800 <= c < 0xE000)))


def _classes() -> np.ndarray:
    """The class of each code point by the library's own tables, which may be of another Unicode version than Python's."""
    from tokenizers import Regex, pre_tokenizers

    table = np.full(sys.maxunicode + 2, _OTHER, np.uint8)
    runs = [(pre_tokenizers.Split(Regex(f"{name}+"), "removed", invert=True), kind) for name, kind in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _BLANK))]
    for part in _alphabet():
        codes = np.frombuffer(part.encode("utf-32-le"), "<u4")
        for splitter, kind in runs:
            for _, (low, high) in splitter.pre_tokenize_str(part):
                table[codes[low:high]] = kind
    table[32] = _SPACE
    table[-1] = _PAD
    return table


def _odd(normalizer) -> frozenset[str]:
    """The characters that the normalizer (composition, then lower case) may treat in another way than Python does, alone
    or beside others: those that the two tables lower differently, and those that Python doesn't know and the library
    composes or moves. The last capital sigma and the dotted I depend on their neighbours."""
    from tokenizers import normalizers

    parted, odd, high, low = normalizers.NFD(), {"Σ", "İ"}, "\u0345", "\u0334"  # combining classes 240 and 1
    for part in _alphabet():
        part = part[128:] if part[0] == "\0" else part
        joined = "\x01".join(part)
        ours = unicodedata.normalize("NFC", joined.lower()).split("\x01")
        theirs = normalizer.normalize_str(joined).split("\x01")
        odd.update(c for c, x, y in zip(part, ours, theirs, strict=True) if x != y and not c.isspace())  # spaces part words in any form
        new = [c for c in part if unicodedata.category(c) == "Cn"]
        if not new:
            continue
        apart = parted.normalize_str("\x01".join(new)).split("\x01")
        odd.update(x for c, d in zip(new, apart, strict=True) if c != d for x in (c, *d))
        for mark in (low, high):
            moved = parted.normalize_str("\x01".join(f"a{mark}{c}{mark}" for c in new)).split("\x01")
            odd.update(c for c, x in zip(new, moved, strict=True) if len(x) == 4 and x != f"a{mark}{c}{mark}")
    return frozenset(odd)


def _splitter(drops_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Next state and mark for each (state, symbol)."""
    step, mark = np.zeros((8, 10), np.uint8), np.full((8, 10), _BEGINS, np.uint8)
    for state in range(8):
        joins = state == _AFTER_SPACE
        for symbol, run in ((_LETTER, _IN_LETTERS), (_NUMBER, _IN_NUMBERS), (_OTHER, _IN_OTHERS)):
            step[state, symbol] = run
            if joins or (state == run and not (drops_space and symbol == _NUMBER)):
                mark[state, symbol] = _CONTINUES
        if state in (_ONE_LEFT, _TWO_LEFT):
            step[state, _LETTER] = _START if state == _ONE_LEFT else _ONE_LEFT
            mark[state, _LETTER] = _CONTINUES
        for symbol, rest in ((_SHORT, _ONE_LEFT), (_LONG, _TWO_LEFT)):
            within = joins or state == _IN_OTHERS
            step[state, symbol] = _IN_OTHERS if within else rest
            mark[state, symbol] = _CONTINUES if within else _BEGINS
        for symbol in (_SPACE, _BLANK, _SPACE_MORE, _BLANK_MORE):
            if drops_space:
                step[state, symbol], mark[state, symbol] = _START, _DROPS
            elif symbol in (_SPACE_MORE, _BLANK_MORE):
                step[state, symbol] = _IN_SPACE
                mark[state, symbol] = _CONTINUES if state == _IN_SPACE else _BEGINS
            else:
                step[state, symbol] = _AFTER_SPACE if symbol == _SPACE else _START
        step[state, _PAD], mark[state, _PAD] = _START, _DROPS
    return step, mark


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps: row i becomes the map of all rows up to i."""
    maps, stride = maps.copy(), 1
    while stride < len(maps):
        maps[stride:] = np.take_along_axis(maps[stride:], maps[:-stride].astype(np.intp), axis=1)
        stride *= 2
    return maps


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand, table = 256, {}
    for byte in range(256):
        if byte in plain:
            table[chr(byte)] = byte
        else:
            table[chr(stand)] = byte
            stand += 1
    return table


#: Above every rank.
_NEVER = 1 << 60


class Merger:
    """The transducer over one pre-token's symbols: bytes, and 256 + byte for a word's last byte where that differs."""

    def __init__(self, model: dict, limit: int | None = None):
        symbols, suffix = _byte_symbols(), model.get("end_of_word_suffix") or ""
        self.bounded, self.limit = limit is not None, limit or MAX_STATES

        def word(token: str) -> str:
            last = bool(suffix) and token.endswith(suffix)
            codes = [symbols[c] for c in (token[: -len(suffix)] if last else token)]
            return "".join(map(chr, codes[:-1])) + chr(codes[-1] + 256 * last)

        self.marks_end = bool(suffix)
        self.ids = {word(t): i for t, i in model["vocab"].items() if not t.startswith("<|")}
        self.words = {i: w for w, i in self.ids.items()}
        self.prefixes = {w[:k] for w in self.ids for k in range(1, len(w))}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (word(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.ranks[self.ids[a], self.ids[b]] = rank, self.ids[a + b]
        size = max(self.words) + 1
        self.lengths = np.zeros(size, np.int64)
        for i, w in self.words.items():
            self.lengths[i] = len(w)
        self.parts = {made: pair for pair, (_, made) in self.ranks.items()}
        self.spines: tuple[dict, dict] = {}, {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.sound: dict[int, bool] = {}
        self.width, self.bytes, self.column = COLUMNS, [], np.full(256, -1, np.int16)
        self.reset()

    def reset(self) -> None:
        """Forget all states but the first."""
        # For each state and byte: the next state, or 1 + a word's last token, above 6 bits of 32 + change; 0: not made.
        self.next = np.zeros((self.limit, self.width), np.int32)
        self.final = np.zeros((self.limit, self.width), np.int32) if self.marks_end else None
        self.last = np.zeros(self.limit, np.int32)
        start = ("", ((0, -1, 0),))
        self.states, self.numbers, self.full = [None, start], {start: 1}, False

    def merge(self, word: str) -> list[int]:
        """The tokens of a symbol string, by its merges."""
        parts = [self.ids[c] for c in word]
        while len(parts) > 1:
            best = min((self.ranks.get(p, (_NEVER, 0)) for p in zip(parts, parts[1:])), default=(_NEVER, 0))
            if best[0] == _NEVER:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and self.ranks.get((parts[i], parts[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that end (side 1) or begin (side 0) a token while it is merged, each with the rank that ends it."""
        known = self.spines[side]
        if token not in known:
            spine, until = [], _NEVER
            inner = token
            while True:
                spine.append((inner, until))
                if inner not in self.parts:
                    break
                until = self.ranks[self.parts[inner]][0]
                inner = self.parts[inner][side]
            known[token] = spine[::-1]
        return known[token]

    def _stay_apart(self, left: int, right: int) -> bool:
        """True if the two tokens' text encodes to just these two.

        Merges go by rank, so the pair at the border is known at any rank: it grows along left's end and right's
        beginning. The border falls if that pair may merge before either side grows; of equal ranks the left one goes first.
        """
        key = left, right
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            ends, begins, i, j = self._spine(left, 1), self._spine(right, 0), 0, 0
            known, ranks = True, self.ranks
            while True:
                (a, until_a), (b, until_b) = ends[i], begins[j]
                across = ranks.get((a, b))
                if across is not None and across[0] < until_a and across[0] <= until_b:
                    known = False
                    break
                if until_a == _NEVER and until_b == _NEVER:
                    break
                if until_a <= until_b:
                    i += 1
                else:
                    j += 1
            self.apart[key] = known
        return known

    def _is_sound(self, token: int) -> bool:
        if token not in self.sound:
            self.sound[token] = self.merge(self.words[token]) == [token]
        return self.sound[token]

    def _step(self, state: int, symbol: int) -> tuple[tuple, int, int]:
        """The next state's content, its last token and the change in the number of tokens."""
        text, entries = self.states[state]
        char, kept = chr(symbol), []
        token = change = None
        for length, before, count in entries:  # longest first
            piece = text[len(text) - length :] + char
            found = self.ids.get(piece)
            if token is None and found is not None and self._is_sound(found):
                if before < 0 or self._stay_apart(before, found):
                    token, change = found, count + 1
            if piece in self.prefixes:
                kept.append((length + 1, before, count))
        if token is None:
            raise ValueError("the vocabulary has no last token for this prefix")
        longest = kept[0][0] if kept else 0
        content = (text + char)[len(text) + 1 - longest :]
        return (content, (*((k, b, c - change) for k, b, c in kept), (0, token, 0))), token, change

    def learn(self, states: np.ndarray, symbols: np.ndarray, final: bool) -> None:
        """Make the transitions of these pairs; in a bounded merger those that are met often, while there is room."""
        pairs, times = np.unique(states.astype(np.int64) * 256 + symbols, return_counts=True)
        for pair in (pairs[times >= OFTEN] if self.bounded else pairs).tolist():
            state, byte = divmod(pair, 256)
            content, token, change = self._step(state, self.bytes[byte] + 256 * final)
            if final:
                self.final[state, byte] = (token + 1) << 6 | change + 32
                continue
            number = self.numbers.get(content)
            if number is None:
                number = len(self.states)
                if number >= self.limit:
                    self.full = self.bounded
                    if self.full:
                        return
                    raise OverflowError
                self.numbers[content] = number
                self.states.append(content)
                self.last[number] = token
            self.next[state, byte] = number << 6 | change + 32

    def _columns(self, data: np.ndarray) -> np.ndarray:
        """The table column of each byte. A byte met first takes the next one; a full table gets one for every byte."""
        columns = self.column[data]
        if len(data) and columns.min() < 0:
            for byte in np.flatnonzero(np.bincount(data[columns < 0], minlength=256)).tolist():
                self.column[byte] = len(self.bytes)
                self.bytes.append(byte)
            if len(self.bytes) > self.width:
                self.width = 256
                self.reset()
            columns = self.column[data]
        return columns

    def run(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, want_last: bool):
        """Tokens of each span of data; with want_last, also the last token after each byte; and which spans left the
        table of a bounded merger, whose tokens are not known. State 0 is of those."""
        data, lengths = self._columns(data), end - begin
        order = np.argsort(-lengths, kind="stable")
        at, size = begin[order], lengths[order]
        state, count = np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
        last = np.zeros(len(data), np.int32) if want_last else None
        reach = np.searchsorted(-size, -np.arange(1, int(size[0]) + 2 if len(size) else 1), side="right")
        for k in range(int(size[0]) if len(size) else 0):
            n = int(reach[k])
            if self.marks_end:  # spans that end here take the word-end symbol
                inner = int(reach[k + 1])
                if inner < n:
                    self._finish(data, at, state, count, last, inner, n, k)
                n = inner
                if not n:
                    break
            where = at[:n] + k
            index = state[:n] * self.width + data[where]
            found = self.next.take(index)
            if not self.full and not found.all():
                missing = np.flatnonzero((found == 0) & (state[:n] > 0))
                self.learn(state[:n][missing], data[where[missing]], final=False)
                found = self.next.take(index)
            count[:n] += (found & 63) - 32
            found >>= 6
            state[:n] = found
            if want_last:
                last[where] = self.last.take(found)
        out, lost = np.empty(len(at), np.int64), np.empty(len(at), bool)
        out[order], lost[order] = count, state == 0
        return out, last, lost

    def _finish(self, data, at, state, count, last, low, high, k) -> None:
        where = at[low:high] + k
        index = state[low:high] * self.width + data[where]
        found = self.final.take(index)
        if not found.all():
            if not self.full:
                missing = np.flatnonzero((found == 0) & (state[low:high] > 0))
                self.learn(state[low:high][missing], data[where[missing]], final=True)
                found = self.final.take(index)
            state[low:high][found == 0] = 0
        count[low:high] += (found & 63) - 32
        if last is not None:
            last[where] = (found >> 6) - 1


class Transducer:
    """A compiled tokenizer: token counts or ids of texts, as the library gives them by default. With states, its merger
    is bounded by that many."""

    def __init__(self, path: str, states: int | None = None):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.normalizer = self.library.normalizer
        self.odd = _odd(self.normalizer) if self.normalizer is not None else frozenset()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merger = Merger(spec["model"], states)
        self.stand_ins = {byte: char for char, byte in _byte_symbols().items()}
        self.bare = Tokenizer(self.library.model)
        self.classes = _classes()
        self.step, self.mark = _splitter(drops_space=self.normalizer is not None)

    def normal(self, text: str) -> str:
        if self.normalizer is None:
            return text
        if text.isascii():
            return text.lower()
        if self.odd.isdisjoint(text) and unicodedata.is_normalized("NFC", text):
            return text.lower()
        return self.normalizer.normalize_str(text)

    def _segments(self, texts: list[str]) -> tuple[list[str | int], list[int]]:
        """Texts cut at special strings, which become ids, and where long at a space that always begins a pre-token."""
        segments, owner = [], []

        def add(text: str, number: int) -> None:
            text, at = self.normal(text), 0
            while at < len(text):
                cut = _SAFE.search(text, at + PIECE) if len(text) - at > PIECE else None
                stop = cut.start() if cut else len(text)
                segments.append(text[at:stop])
                owner.append(number)
                at = stop

        for number, text in enumerate(texts):
            while True:
                found = [(text.find(s), s) for s in self.special if s in text]
                if not found:
                    add(text, number)
                    break
                at, name = min(found)
                add(text[:at], number)
                segments.append(self.special[name])
                owner.append(number)
                text = text[at + len(name) :]
        return segments, owner

    def split(self, segments: list[str]):
        """UTF-8 bytes of the segments, begin and end of each pre-token in them, and its segment."""
        code = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        chunks = sizes // CHUNK + 1  # so one pad at least follows each segment
        first = np.concatenate(([0], np.cumsum(chunks)))
        points = np.full(int(first[-1]) * CHUNK, sys.maxunicode + 1, np.uint32)
        at = np.repeat(first[:-1] * CHUNK - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(len(code))
        points[at] = code
        symbol = self.classes[points]
        solid = np.zeros(len(symbol), bool)
        solid[:-1] = symbol[1:] <= _OTHER
        symbol[(symbol == _SPACE) & ~solid] = _SPACE_MORE
        symbol[(symbol == _BLANK) & ~solid] = _BLANK_MORE
        quotes = np.flatnonzero(points == 39)  # a pad follows every segment, so two places on are in range or of a pad
        if len(quotes):
            one, two = points[quotes + 1], points[np.minimum(quotes + 2, len(points) - 1)]
            symbol[quotes[np.isin(one, [ord(c) for c in ONE_LETTER])]] = _SHORT
            pairs = [ord(a) << 32 | ord(b) for a, b in TWO_LETTERS]
            symbol[quotes[np.isin(one.astype(np.uint64) << np.uint64(32) | two, np.array(pairs, np.uint64))]] = _LONG
        marks = self._marks(symbol.reshape(-1, CHUNK), first[:-1]).reshape(-1)
        width = 1 + (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000)
        width[points > sys.maxunicode] = 0
        offset = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
        edges = np.flatnonzero(marks)  # begins and drops; a pad drops, so every pre-token has an edge after it
        begins = marks[edges] == _BEGINS
        stops = np.concatenate((edges[1:], [len(marks)]))[begins]
        starts = edges[begins]
        data = np.frombuffer("".join(segments).encode(), np.uint8)
        segment = np.searchsorted(first, starts // CHUNK, side="right") - 1
        return data, offset[starts], offset[stops], segment

    def _marks(self, symbols: np.ndarray, heads: np.ndarray) -> np.ndarray:
        step, states = self.step.reshape(-1), len(self.step)
        columns = np.ascontiguousarray(symbols.T).astype(np.intp)
        maps = np.tile(np.arange(states, dtype=np.uint8), (len(symbols), 1))
        for k in range(SETTLE):
            maps = step[maps.astype(np.intp) * 10 + columns[k][:, None]]
        same = (maps == maps[:, :1]).all(axis=1)
        settled, loose = np.flatnonzero(same), np.flatnonzero(~same)
        rows = step.astype(np.intp) * 10  # where the next state's row begins
        one, inner = maps[settled, 0].astype(np.intp) * 10, columns if len(settled) == len(symbols) else columns[:, settled]
        for k in range(SETTLE, CHUNK):
            one = rows.take(one + inner[k])
        rest = maps[loose]
        for k in range(SETTLE, CHUNK if len(loose) else SETTLE):
            rest = step[rest.astype(np.intp) * 10 + columns[k, loose][:, None]]
        maps[settled], maps[loose] = one[:, None] // 10, rest
        maps[heads] = maps[heads, :1]  # a segment always enters at the start state, so scans don't cross segments
        entry = np.zeros(len(symbols), np.uint8)
        entry[1:] = compose_scan(maps)[:-1, 0]
        entry[heads] = _START
        marks, mark = np.empty(columns.shape, np.uint8), self.mark.reshape(-1)
        row = entry.astype(np.intp) * 10
        for k in range(CHUNK):
            index = row + columns[k]
            marks[k] = mark.take(index)
            row = rows.take(index)
        return np.ascontiguousarray(marks.T)

    def _encoded(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens by the library, one after another, and how many each has. Equal ones are encoded once."""
        text, places = data.tobytes().decode("latin-1").translate(self.stand_ins), {}
        which = np.fromiter((places.setdefault(text[b:e], len(places)) for b, e in zip(begin.tolist(), end.tolist())), np.int64, len(begin))
        found = self.bare.encode_batch_fast([list(places)], is_pretokenized=True, add_special_tokens=False)
        ids, stops = np.array(found[0].ids, np.int32), np.cumsum(np.fromiter(map(len, places), np.int64, len(places)))
        stops = np.searchsorted(np.cumsum(self.merger.lengths[ids]), stops, side="right")  # tokens cover their word's bytes
        sizes = np.diff(stops, prepend=0)
        heads, count = stops - sizes, sizes[which]
        return ids[np.repeat(heads[which] - (np.cumsum(count) - count), count) + np.arange(count.sum())], count

    def _tokens(self, begin, end, count, last, lost: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """The ids of all pre-tokens in turn: rare those of the lost ones, others found from the last token backwards."""
        stops = np.cumsum(count)
        flat, at, slot = np.empty(int(stops[-1]) if len(stops) else 0, np.int32), end.copy(), stops - 1
        if len(rare):
            sizes = count[lost]
            flat[np.repeat(stops[lost] - np.cumsum(sizes), sizes) + np.arange(len(rare))] = rare
        live = np.flatnonzero(~lost)
        while len(live):
            token = last[at[live] - 1]
            flat[slot[live]] = token
            at[live] -= self.merger.lengths[token]
            slot[live] -= 1
            live = live[at[live] > begin[live]]
        return flat

    def _run(self, segments: list[str], want_ids: bool) -> list:
        data, begin, end, segment = self.split(segments)
        try:
            count, last, lost = self.merger.run(data, begin, end, want_ids)
        except OverflowError:  # the table is full: start again, and with less text if one batch fills it
            self.merger.reset()
            if len(segments) > 1:
                half = len(segments) // 2
                return self._run(segments[:half], want_ids) + self._run(segments[half:], want_ids)
            try:
                count, last, lost = self.merger.run(data, begin, end, want_ids)
            except OverflowError:
                self.merger.reset()
                ids = self.library.encode(segments[0], add_special_tokens=False).ids
                return [np.array(ids, np.int32)] if want_ids else [len(ids)]
        rare = np.empty(0, np.int32)
        if lost.any():
            rare, count[lost] = self._encoded(data, begin[lost], end[lost])
        per_segment = np.zeros(len(segments), np.int64)
        np.add.at(per_segment, segment, count)
        if not want_ids:
            return per_segment.tolist()
        return np.split(self._tokens(begin, end, count, last, lost, rare), np.cumsum(per_segment)[:-1])

    def _each(self, texts: list[str], want_ids: bool) -> tuple[list, list[int]]:
        """The result of each segment, and the text it belongs to."""
        segments, owner = self._segments(texts)
        out: list = [s if isinstance(s, int) else None for s in segments]
        group: list[int] = []
        size = 0
        for number, s in enumerate([*segments, None]):
            if group and (s is None or (isinstance(s, str) and size + len(s) > PIECE)):
                for i, result in zip(group, self._run([segments[i] for i in group], want_ids), strict=True):
                    out[i] = result
                group, size = [], 0
            if isinstance(s, str):
                group.append(number)
                size += len(s)
        for number, s in enumerate(segments):
            if isinstance(s, int):
                out[number] = np.array([s], np.int32) if want_ids else 1
        return out, owner

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out = [0] * len(texts)
        for n, number in zip(*self._each(texts, False), strict=True):
            out[number] += n
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for part, number in zip(*self._each(texts, True), strict=True):
            out[number].append(part)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.empty(0, np.int32) for x in out]


_compiled: dict[tuple[str, int | None], Transducer] = {}


def transducer(name: str, states: int | None = None) -> Transducer:
    """One compiled tokenizer per worker process, vocabulary and bound of states."""
    if (name, states) not in _compiled:
        import public_tokenizers

        _compiled[name, states] = Transducer(public_tokenizers.path(name), states)
    return _compiled[name, states]
