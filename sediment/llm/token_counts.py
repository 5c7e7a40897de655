"""Token counts by a tokenizer compiled to a deterministic finite-state transducer.

A lower-cased text is read as symbols: the bytes of letters and other marks, with the class of the
character on its first byte, one symbol for all white space and one for each number of tokens that a
digit gives. A state holds the kind of piece it is in (letters, others, the start of a contraction)
and, for the piece so far, the longest suffix that some vocabulary entry begins with, together with
the last token of the encoding of every prefix that ends within that suffix. For byte-pair merges this
is enough: a prefix's encoding is the encoding of a shorter prefix plus one token, and that token is
the only one that makes a stable pair with the last token before it. So the states are finite, and
each transition carries the number of tokens by which the count changes. States are compiled when
first met and the table is emptied when it is full, which bounds it for any corpus.

Texts are laid end to end and cut into chunks of equal length, which numpy reads in step. White space,
digits and changes between letters and others lead to one state, whatever came before, so what follows
the first of them in a chunk is read at once. The head before it, or a whole chunk without one, is a
map from entry state to exit state and count. Each map is read for one entry first, guessed from the
bytes before the chunk, then for every exit that the map before it has and that it lacks. Maps are
composed by a parallel prefix scan, in as many steps as the number of chunks has binary digits.

Defined results: a null or empty text has 0 tokens; other columns and repeated rows pass through; a
text without white space, of any length and script, is read like any other; an empty table gives none.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.llm.common import plain_name, sliced

UNKNOWN, START = 0, 1
#: Symbols beyond the bytes: first bytes of letters and of others, bytes that change nothing, and numbers by their tokens.
LETTER, OTHER, SKIP, NUMBER, SYMBOLS = 256, 512, 768, 1024, 1280
#: Symbols read before the table may be emptied, and bytes of a chunk.
SEGMENT, CHUNK = 4_000_000, 512
#: Bytes before a chunk from which its entry state is guessed, and the rounds in which all maps may grow.
WARM, ROUNDS = 48, 40
#: A byte that UTF-8 never uses stands for a special token.
SPECIAL = 0xFF
#: Cells of the transition table (five bytes each) at which it is emptied.
TABLE_CELLS = 32_000_000
#: Fixed values of the vocabulary's split pattern.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_symbols() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """Merge ranks, and which pairs of tokens stay as they are when written side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        pairs = (tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"])
        self.rank = {m: n for n, m in enumerate(pairs)}
        self.symbol = byte_symbols()
        back = {c: b for b, c in enumerate(self.symbol)}
        self.specials = [t["content"] for t in spec["added_tokens"]]
        #: (bytes, at the end of a word) of every entry.
        self.entries, self.heads = set(), {b""}
        for word in model["vocab"]:
            if word in self.specials:
                continue
            last = word.endswith(self.end)
            own = bytes(back[c] for c in (word.removesuffix(self.end) if last else word))
            if own and self.merged(own, last) == [(own, last)]:
                self.entries.add((own, last))
                self.heads.update(own[:n] for n in range(1, len(own) + 1))
        self.stable: dict[tuple, bool] = {}

    def merged(self, own: bytes, last: bool) -> list[tuple[bytes, bool]]:
        """The encoding of a piece: the lowest-ranked pair is merged first, from the left."""
        parts = [self.symbol[b] for b in own]
        if last:
            parts[-1] += self.end
        rank = self.rank
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        out, at = [], 0
        for n, part in enumerate(parts):
            size = len(part) - (len(self.end) if last and n == len(parts) - 1 else 0)
            out.append((own[at : at + size], last and n == len(parts) - 1))
            at += size
        return out

    def side_by_side(self, one: bytes, two: bytes, last: bool) -> bool:
        key = (one, two, last)
        if key not in self.stable:
            if len(self.stable) > 1_000_000:
                self.stable.clear()
            self.stable[key] = self.merged(one + two, last) == [(one, False), (two, last)]
        return self.stable[key]


#: The piece so far: its suffix, and for each prefix that ends in the suffix (the longest last) its
#: last token and its count less the count of the whole. Empty at the start of a piece.
Window = tuple[bytes, tuple[tuple[bytes, int], ...]]
EMPTY: Window = (b"", ((b"", 0),))


class Alphabet:
    """Symbols of characters, worked out when a character is first met."""

    #: Classes of bytes: they end a piece alone, are letters, others or an apostrophe.
    ALONE, LETTERS, OTHERS, QUOTE = range(4)

    def __init__(self, merges: Merges):
        self.merges = merges
        self.kind = np.full(0x110000, -1, "i2")  # LETTER, OTHER, the symbol of white space, or NUMBER and its tokens
        self.symbol, self.group = np.arange(256, dtype="i2"), np.full(256, self.ALONE, "u1")
        for byte in range(0x80):
            kind = self._kind(chr(byte))
            self.group[byte] = self._group(kind)
            if self.group[byte] == self.ALONE:
                self.symbol[byte] = kind
        self.group[0x27] = self.QUOTE

    def _kind(self, char: str) -> int:
        category = unicodedata.category(char)
        if char in "\t\n\v\f\r \x85\xa0" or category in ("Zs", "Zl", "Zp"):
            return 0x20
        if category[0] == "N":
            return NUMBER + len(self.merges.merged(char.encode(), True))
        return LETTER if category[0] == "L" else OTHER

    def _group(self, kind: int) -> int:
        return {LETTER: self.LETTERS, OTHER: self.OTHERS}.get(kind, self.ALONE)

    def symbols(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, settled) of each byte of UTF-8 with special tokens as SPECIAL; after a settled one the state is known."""
        symbol, group = self.symbol[data], self.group[data]
        lead = np.flatnonzero((data >= 0xC0) & (data != SPECIAL))
        if len(lead):
            code, size = data[lead].astype("i4"), 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0).astype("i4")
            for width, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
                at = np.flatnonzero(size == width)
                value = code[at] & mask
                for k in range(1, width):
                    value = (value << 6) | (data[lead[at] + k] & 0x3F)
                code[at] = value
            for new in np.unique(code[self.kind[code] < 0]).tolist():
                self.kind[new] = self._kind(chr(new))
            kind = self.kind[code]
            of = np.where(kind == LETTER, self.LETTERS, np.where(kind == OTHER, self.OTHERS, self.ALONE)).astype("u1")
            symbol[lead] = np.where(of == self.ALONE, kind, symbol[lead] + kind)
            group[lead] = of
            for k in range(1, 4):
                rest = size > k
                group[lead[rest] + k] = of[rest]
                symbol[lead[rest & (of == self.ALONE)] + k] = SKIP
        settled = group == self.ALONE
        settled[symbol == SKIP] = False
        pair = group[1:] * 4 + group[:-1]
        settled[1:] |= (pair == self.LETTERS * 4 + self.OTHERS) | (pair == self.OTHERS * 4 + self.LETTERS)
        return symbol, settled


class Transducer:
    def __init__(self, path: str):
        self.merges = Merges(path)
        self.alphabet = Alphabet(self.merges)
        self.special = re.compile("|".join(map(re.escape, self.merges.specials)) or r"(?!)")
        self.plain = {n: (OTHER, LETTER)[chr(n).isalpha()] for n in range(0x21, 0x7F)}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [("?", EMPTY), ("S", EMPTY)]
        self.number = {s: n for n, s in enumerate(self.states)}
        self.suffixes: dict[bytes, tuple[bytes, tuple, tuple]] = {}
        self.column = np.full(SYMBOLS, -1, "i4")
        self.used, self.width = 0, 64
        self.next = np.full((4096, self.width), -1, "i4")
        self.emit = np.zeros((4096, self.width), "i1")
        self.next[UNKNOWN] = UNKNOWN

    def intern(self, state: tuple) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            if len(self.states) > len(self.next):
                more = len(self.next) // 2
                self.next = np.concatenate([self.next, np.full((more, self.width), -1, "i4")])
                self.emit = np.concatenate([self.emit, np.zeros((more, self.width), "i1")])
        return self.number[state]

    # the piece so far ------------------------------------------------------------------------
    def _suffix(self, text: bytes) -> tuple[bytes, tuple, tuple]:
        """The longest suffix of text that an entry begins with, and the entries that end it: inside a piece, at its end."""
        if (got := self.suffixes.get(text)) is None:
            own = text
            while own not in self.merges.heads:
                own = own[1:]
            ends = [own[-size:] for size in range(len(own), 0, -1)]
            got = self.suffixes[text] = (own, *(tuple(t for t in ends if (t, last) in self.merges.entries) for last in (False, True)))
        return got

    def _token(self, tokens: tuple, chain: tuple, last: bool) -> tuple[bytes, int]:
        """The last token and the relative count of the piece that tokens end; chain has the prefixes before it."""
        room = len(chain)
        for token in tokens:
            if len(token) > room:
                continue
            before, count = chain[room - len(token)]
            if not before or self.merges.side_by_side(before, token, last):
                return token, count + 1
        raise ValueError(f"no token ends a piece: {tokens!r}")

    def _longer(self, window: Window, byte: int) -> tuple[Window, int]:
        """The piece with one more byte, and by how much its count changes."""
        suffix, chain = window
        suffix, inside, _ = self._suffix(suffix + bytes((byte,)))
        token, count = self._token(inside, chain, False)
        chain = chain[-len(suffix) :]
        if count:
            chain = tuple([(t, c - count) for t, c in chain])
        return (suffix, (*chain, (token, 0))), count

    def _closed(self, window: Window) -> int:
        """By how much the count changes when the piece ends here."""
        suffix, chain = window
        if not suffix:
            return 0
        return self._token(self._suffix(suffix)[2], chain[:-1], True)[1]

    # the split into pieces -------------------------------------------------------------------
    def _piece(self, text: str) -> int:
        return len(self.merges.merged(text.encode(), True))

    def _step(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        """The state after a symbol, and the change of the count."""
        kind, window = state
        if symbol == SKIP:
            return state, 0
        if 0x80 <= symbol < 0xC0:
            window, count = self._longer(window, symbol)
            return (kind, window), count
        if symbol == SPECIAL:
            return self._step(state, 0x20)[0], self._step(state, 0x20)[1] + 1
        number = symbol - NUMBER if symbol >= NUMBER else 0
        into = "N" if number else "S" if symbol == 0x20 else "L" if self.plain.get(symbol, symbol & 0x300) == LETTER else "O"
        count = 0
        if kind[0] == "'":  # the start of a contraction
            grown = kind + chr(symbol) if symbol < 0x80 else "?"
            if grown in CONTRACTIONS:
                return self.states[START], self._piece(grown)
            if any(c.startswith(grown) for c in CONTRACTIONS):
                return (grown, EMPTY), 0
            if len(kind) == 1:  # an apostrophe alone begins a piece of others
                window, count = self._longer(EMPTY, 0x27)
                kind = "O"
            else:  # an apostrophe as a piece of its own, then a letter
                count = self._piece("'")
                window, more = self._longer(EMPTY, ord(kind[1]))
                kind, count = "L", count + more
        if kind in "LO" and into != kind:
            count += self._closed(window)
            window, kind = EMPTY, "S"
        if into in "SN":
            return self.states[START], count + number
        if kind == "S" and symbol == 0x27:
            return ("'", EMPTY), count
        window, more = self._longer(window, symbol & 0xFF)
        return (into, window), count + more

    def compile(self, state: int, symbol: int) -> None:
        """Add the transition from a state on a symbol to the table."""
        after, count = self._step(self.states[state], symbol)
        number = self.intern(after)
        self.next[state, self.column[symbol]] = number
        self.emit[state, self.column[symbol]] = count

    def _columns(self, symbols: np.ndarray) -> np.ndarray:
        new = np.flatnonzero(np.bincount(symbols, minlength=SYMBOLS))
        new = new[self.column[new] < 0]
        if len(new):
            self.column[new] = self.used + np.arange(len(new))
            self.used += len(new)
            if (more := -(-(self.used - self.width) // 16) * 16) > 0:
                self.next = np.concatenate([self.next, np.full((len(self.next), more), -1, "i4")], axis=1)
                self.emit = np.concatenate([self.emit, np.zeros((len(self.emit), more), "i1")], axis=1)
                self.next[UNKNOWN] = UNKNOWN
                self.width += more
        return self.column.astype("u2")[symbols]

    # chunks ----------------------------------------------------------------------------------
    def _run(self, symbols: np.ndarray, cols: np.ndarray, lanes: np.ndarray, state: np.ndarray, stop: np.ndarray, wake: np.ndarray | None = None) -> tuple:
        """Read chunks in step, each to its stop; returns the exit states and, for each chunk, the change of the count.

        With wake, chunks are asleep until that row, which is read from START without being counted,
        and the changes of each row come back in place of their sums.
        """
        state, total = state.copy(), np.zeros(len(lanes), "i8")
        out = np.zeros(symbols.shape, "i1") if wake is not None else None
        order = np.argsort(wake if wake is not None else -stop, kind="stable")
        turn = (wake if wake is not None else -stop)[order]
        rows = int(stop.max(initial=0))
        begins = np.searchsorted(turn, np.arange(rows + 1)) if wake is not None else np.searchsorted(turn, -np.arange(rows))
        for t in range(rows):
            fresh = None
            if wake is not None:
                if begins[t] < begins[t + 1]:
                    fresh = order[begins[t] : begins[t + 1]]
                    state[fresh] = START
                on = at = slice(None)
            elif begins[t] == symbols.shape[1]:
                on = at = slice(None)
            else:
                on = order[: begins[t]]
                at = lanes[on]
            now = state[on]
            key = now * self.width + cols[t, at]
            after = self.next.ravel().take(key)
            if (after < 0).any():
                missing = np.flatnonzero(after < 0)
                missing = missing[np.unique(key[missing], return_index=True)[1]]
                for one, symbol in zip(now[missing].tolist(), symbols[t, at][missing].tolist(), strict=True):
                    self.compile(one, symbol)
                after = self.next.ravel().take(key)
            gained = self.emit.ravel().take(key)
            state[on] = after
            if out is None:
                total[on] += gained
            else:
                out[t] = gained
                if fresh is not None:
                    out[t, fresh] = 0
        return state, total if out is None else out

    def _segment(self, data: np.ndarray, symbols: np.ndarray, settled: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        """(change of the count at each byte, exit state) of some bytes; what a chunk's head gives stands at its first byte."""
        n = len(data)
        wide = -(-n // CHUNK)
        padded, known = np.full(wide * CHUNK, SKIP, "i2"), np.zeros(wide * CHUNK, bool)
        padded[:n], known[:n] = symbols, settled
        symbols, known = (np.ascontiguousarray(x.reshape(wide, CHUNK).T) for x in (padded, known))
        cols = self._columns(symbols.ravel()).reshape(symbols.shape)
        lanes, broken = np.arange(wide), known.any(axis=0)
        first = np.where(broken, known.argmax(axis=0), CHUNK)
        exits, out = self._run(symbols, cols, lanes, np.full(wide, UNKNOWN, "i8"), np.full(wide, CHUNK), first)
        head = np.minimum(first + 1, CHUNK)

        # Maps of the heads: of each chunk, the entries read so far, their exits and their counts.
        starts = np.concatenate([[entry], exits[:-1]])
        unsure = np.flatnonzero(starts == UNKNOWN)
        if len(unsure):
            warm = symbols[-WARM:, unsure - 1].copy()
            for k in range(3):  # the rest of a character
                part = (warm[: k + 1] >= 0x80).all(axis=0) & (warm[k] >= 0x80) & (warm[k] < 0xC0)
                warm[k, part] = SKIP
            self._columns(np.array([SKIP], "i2"))
            starts[unsure] = self._run(warm, self.column[warm], np.arange(len(unsure)), np.full(len(unsure), START), np.full(len(unsure), WARM))[0]
        entries, leaves, sums, many = starts[:, None].copy(), np.full((wide, 1), -1), np.zeros((wide, 1), "i8"), np.ones(wide, "i8")
        todo, slot, rounds = lanes, np.zeros(wide, "i8"), 0
        while len(todo):
            got, gained = self._run(symbols, cols, todo, entries[todo, slot], head[todo])
            leaves[todo, slot], sums[todo, slot] = np.where(broken[todo], exits[todo], got), gained
            # Composition: which entry of each chunk stands for each entry of the chunk before it.
            slots = entries.shape[1]
            match = (leaves[:-1, :, None] == entries[1:, None, :]) & (np.arange(slots) < many[1:, None, None])
            known_exit = np.arange(slots) < many[:-1, None]
            to = np.where(match.any(axis=2) & known_exit, match.argmax(axis=2), slots)
            to = np.hstack([to, np.full((len(to), 1), slots)])
            lacking = (to[:, :slots] == slots) & known_exit
            scan, step = to, 1
            while step < len(scan):
                scan = np.vstack([scan[:step], np.take_along_axis(scan[step:], scan[:-step], axis=1)])
                step *= 2
            pick = np.concatenate([[0], scan[:, 0]])
            rounds += 1
            if rounds > ROUNDS:  # go on from where the true path is known
                row = np.arange(len(to))
                lacking &= (np.arange(slots) == pick[:-1, None]) & (pick[row] < slots)[:, None]
            if (pick < slots).all():
                break
            before = np.flatnonzero(lacking.any(axis=1))
            new = leaves[before, lacking[before].argmax(axis=1)]
            todo = before + 1
            slot = many[todo]
            if int(slot.max()) == slots:
                entries, leaves, sums = (np.hstack([x, np.full((wide, 1), -1, x.dtype)]) for x in (entries, leaves, sums))
            entries[todo, slot] = new
            many[todo] += 1
        change = np.ascontiguousarray(out.T).ravel().astype("i4")
        change[:: CHUNK] += sums[lanes, pick].astype("i4")
        return change[:n], int(leaves[-1, pick[-1]])

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text, given as normalised bytes."""
        if not texts:
            return np.zeros(0, "i8")
        flat = np.frombuffer(b" ".join(texts) + b" ", "u1")
        symbols, settled = self.alphabet.symbols(flat)
        change, state = np.zeros(len(flat), "i4"), START
        for at in range(0, len(flat), SEGMENT):
            if len(self.states) * self.width > TABLE_CELLS:
                held = self.states[state]
                self.reset()
                state = self.intern(held)
            part = slice(at, min(at + SEGMENT, len(flat)))
            change[part], state = self._segment(flat[part], symbols[part], settled[part], state)
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts[:-1]])]).astype("i8")
        return np.add.reduceat(change, starts).astype("i8")


def normalised(text: str | None, special: re.Pattern) -> bytes:
    """Composed, lower-cased UTF-8 of a text, with special tokens as one byte."""
    if not text:
        return b""
    if "<|" in text and special.search(text):
        return bytes([SPECIAL]).join(normalised(x, special) for x in special.split(text))
    if not text.isascii():
        # Letter by letter: a capital sigma has one lower-case form here, wherever it stands.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower().encode()


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One transducer per worker process and vocabulary."""
    return Transducer(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, text_col: str = "text", block_bytes: int = 8_000_000) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (they replace columns of these names)."""
    base = plain_name(docs, ["n_bytes", "n_tokens", "over_limit"])

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for part in sliced(parts, 4000):
            texts = part.column(text_col).to_pylist()
            sizes, counts, block, held = [], [], [], 0
            for text in texts:
                sizes.append(len((text or "").encode()))
                block.append(normalised(text, machine.special))
                held += len(block[-1])
                if held > block_bytes:
                    counts.append(machine.counts(block))
                    block, held = [], 0
            counts.append(machine.counts(block))
            n = np.concatenate(counts)
            out = part.append_column("n_bytes", pa.array(sizes, pa.int64())).append_column("n_tokens", pa.array(n))
            yield out.append_column("over_limit", pa.array(n > limit))

    kept = base.withColumn(text_col, F.col(text_col).cast("string"))
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return kept.mapInArrow(count, T.StructType([*kept.schema.fields, *added]))
