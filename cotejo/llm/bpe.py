"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A sequence of tokens is the BPE encoding of its bytes exactly if every two neighbours stay two
tokens when their bytes are merged alone. So the encodings of all prefixes of a text can be grown
byte by byte: of the tokens that end at a place exactly one follows the encoding up to its start.
The machine that knows the tokens ending at each place is the determinised trie of all tokens: a
state is the set of places whose following bytes still begin a token. States and steps are made
when first met and kept in a bounded table, so nothing is compiled for byte strings that never
occur. Tokens are emitted once the encodings up to all live places agree on them.

Pieces (matches of the split pattern) that are tokens themselves are emitted whole, as the
rank files' own encoder does.

Defined results: a NULL text counts as empty and has no tokens; repeated rows are encoded alike;
an empty table gives no rows; a column of the input that has the name of a result column, in any
case, is replaced by it; a long text is encoded whole, its settled tokens given out on the way.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.llm.common import text_of, with_columns

#: Entries of the tables of steps and of encoded pieces; a full one is emptied.
STEPS = 300_000
PIECES = 300_000
#: Bytes after which a long piece gives up the tokens that are settled.
LOOK_BACK = 4096
#: Tokens in one batch of rows given back to Spark.
BATCH_TOKENS = 2_000_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank in each line."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The merges done one by one, lowest rank first, leftmost first: the definition."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(
            (ranks.get(parts[i] + parts[i + 1], np.inf), i) for i in range(len(parts) - 1)
        )
        if best[0] == np.inf:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


class Transducer:
    """Bytes in, token ids out."""

    def __init__(self, ranks: dict[bytes, int], max_steps: int = STEPS) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.size_of = {rank: len(token) for token, rank in ranks.items()}
        self.max_steps = max_steps
        self._step: dict[int, int] = {}  # node * 256 + byte -> node
        self._token: dict[int, int] = {}  # node -> token that ends there
        self._depth = [0]
        inner = set()
        for token, rank in ranks.items():
            at = 0
            for byte in token:
                inner.add(at)
                to = self._step.get(at << 8 | byte)
                if to is None:
                    to = self._step[at << 8 | byte] = len(self._depth)
                    self._depth.append(self._depth[at] + 1)
                at = to
            self._token[at] = rank
        self._inner = inner  # nodes that longer tokens pass through
        self._edges: dict[int, tuple | None] = {}
        self._pairs: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        #: A state is the nodes of the places whose following bytes still begin a token.
        self._states: list[tuple[int, ...]] = []
        self._number: dict[tuple[int, ...], int] = {}
        self._moves: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}
        self._state((0,))

    def _state(self, nodes: tuple[int, ...]) -> int:
        number = self._number.get(nodes)
        if number is None:
            number = self._number[nodes] = len(self._states)
            self._states.append(nodes)
        return number

    def _edge(self, token: int) -> tuple | None:
        """What stands at either end of a token while it is being merged, each part with the rank
        of the merge that takes it in; None for a token that merging its bytes does not make."""
        if token in self._edges:
            return self._edges[token]
        ranks, data = self.ranks, self.bytes_of[token]
        parts = [data[i : i + 1] for i in range(len(data))]
        left, right, monotone, before = [], [], True, -1
        while len(parts) > 1:
            rank, at = min(
                (ranks.get(parts[i] + parts[i + 1], np.inf), i) for i in range(len(parts) - 1)
            )
            if rank == np.inf:
                break
            monotone &= rank >= before
            before = rank
            if at == 0:
                left.append((parts[0], rank))
            if at == len(parts) - 2:
                right.append((parts[-1], rank))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        made = len(parts) == 1
        left.append((data, np.inf))
        right.append((data, np.inf))
        self._edges[token] = (left, right, monotone) if made else None
        return self._edges[token]

    def _fits(self, last: int, token: int) -> bool:
        """Whether two tokens stay apart when their bytes are merged alone."""
        if len(self._pairs) >= self.max_steps:
            self._pairs.clear()
        fits = self._pairs[last << 32 | token] = self._apart(last, token)
        return fits

    def _apart(self, last: int, token: int) -> bool:
        _, right, monotone = self._edge(last)
        left, _, also = self._edge(token)
        if not (monotone and also):
            a, b = self.bytes_of[last], self.bytes_of[token]
            return merge(a + b, self.ranks) == [a, b]
        # ranks of merges only rise, so a merge across comes about if it outranks both merges
        # that would take its parts in; of equal ranks the leftmost merge comes first
        for x, x_taken in right:
            for y, y_taken in left:
                across = self.ranks.get(x + y)
                if across is not None and across < x_taken and across <= y_taken:
                    return False
        return True

    def _move(self, state: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """The next state, and the tokens that end here with their sizes, longest first."""
        live, ended = [], []
        for node in self._states[state]:
            to = self._step.get(node << 8 | byte)
            if to is None:
                continue
            token = self._token.get(to)
            if token is not None and self._edge(token) is not None:
                ended.append((token, self.size_of[token]))
            if to in self._inner:
                live.append(to)
        return self._state((*live, 0)), tuple(ended)

    def _back(self, ends: list[int], at: int) -> list[int]:
        """Tokens up to a place, the last one first. ends: the last token before each place."""
        found = []
        while at > 0:
            found.append(ends[at])
            at -= self.size_of[ends[at]]
        return found

    def tokens(self, data: bytes) -> list[int]:
        if len(self._moves) >= self.max_steps:
            self._reset()
        out: list[int] = []
        ends, state = [-1], 0
        for start in range(0, len(data), LOOK_BACK):
            if start:
                ends = self._settle(ends, state, out)
                if len(self._moves) >= self.max_steps:
                    nodes = self._states[state]
                    self._reset()
                    state = self._state(nodes)
            state = self._run(data[start : start + LOOK_BACK], state, ends)
        out += reversed(self._back(ends, len(ends) - 1))
        return out

    def _run(self, data: bytes, state: int, ends: list[int]) -> int:
        """Adds the last token before each place behind the bytes; gives the state there."""
        moves, pair, move_of, add = self._moves, self._pairs.get, self._moves.get, ends.append
        for byte in data:
            move = move_of(state << 8 | byte)
            if move is None:
                move = moves[state << 8 | byte] = self._move(state, byte)
            state, ended = move
            for token, size in ended:  # exactly one follows what is before it
                last = ends[-size]
                if last < 0:
                    break
                fits = pair(last << 32 | token)
                if fits or (fits is None and self._fits(last, token)):
                    break
            add(token)
        return state

    def _settle(self, ends: list[int], state: int, out: list[int]) -> list[int]:
        """Gives out the tokens that the encodings up to all live places share, and cuts them off;
        the last of them stays as what is before the first place."""
        at = len(ends) - 1
        paths = [
            self._back(ends, at - self._depth[node])[::-1] for node in self._states[state]
        ]
        shared = 0
        while all(len(p) > shared and p[shared] == paths[0][shared] for p in paths):
            shared += 1
        tokens = paths[0][:shared]
        out += tokens
        return ends[sum(self.size_of[t] for t in tokens) :]


class Encoder:
    """Texts in, token ids out: split into pieces, each through the transducer.

    ``blanks_split`` says that the pattern always splits before a blank that stands between two
    characters other than white space, and takes a blank and the letters behind it as one piece, as
    patterns of the GPT-2 kind do. Texts with no other blanks are then cut there, and what lies
    between is looked up whole.
    """

    def __init__(
        self,
        ranks: dict[bytes, int],
        pattern: str,
        blanks_split: bool = False,
        max_pieces: int = PIECES,
    ) -> None:
        self.transducer = Transducer(ranks)
        self.find = regex.compile(pattern).findall
        self.blanks_split = blanks_split
        self.max_pieces = max_pieces
        self._known: dict[str, tuple[int, ...]] = {}  # by piece
        self._after_blank: dict[str, tuple[int, ...]] = {}  # by what follows a blank

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self._known.get(piece)
        if ids is None:
            data = piece.encode("utf-8")
            rank = self.transducer.ranks.get(data)
            ids = (rank,) if rank is not None else tuple(self.transducer.tokens(data))
            self._keep(self._known, piece, ids)
        return ids

    def _keep(self, table: dict, key: str, ids: tuple[int, ...]) -> None:
        if len(key) <= 64:
            if len(table) >= self.max_pieces:
                table.clear()
            table[key] = ids

    def _pieces(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._piece, self.find(text))))

    def _word(self, word: str) -> tuple[int, ...] | None:
        """Ids of a blank and the word; None for a word that has white space at an end, or is empty,
        as the blank may then belong to another piece."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        # letters of Latin-1 are one piece with the blank, whichever version of Unicode is read
        simple = self.blanks_split and word.isalpha() and max(word) <= "ÿ"
        pieces = [" " + word] if simple else self.find(" " + word)
        if len(pieces) == 1:
            data = pieces[0].encode("utf-8")
            rank = self.transducer.ranks.get(data)
            ids = (rank,) if rank is not None else tuple(self.transducer.tokens(data))
        else:
            ids = tuple(chain.from_iterable(map(self._piece, pieces)))
        self._keep(self._after_blank, word, ids)
        return ids

    def encode(self, text: str) -> list[int]:
        return self.batch(pa.array([text], pa.string()))[0].as_py()

    def batch(self, texts: pa.StringArray) -> pa.ListArray:
        """The ids of many texts without NULLs. Words between blanks are encoded once each."""
        if not self.blanks_split:
            return _lists([self._pieces(x) for x in texts.to_pylist()])
        split = pa.compute.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy()
        bounds = bounds - bounds[0]
        words = split.flatten().dictionary_encode()
        at = words.indices.to_numpy().astype(np.int64)
        known, names = self._after_blank, words.dictionary.to_pylist()
        found = [known.get(w) or self._word(w) for w in names]
        odd = np.fromiter((x is None for x in found), bool, len(found))
        # the first word of a text has no blank before it; ids of an odd text are held there
        first, later = bounds[:-1], np.ones(len(at), bool)
        later[first] = False
        odd_before = np.concatenate([[0], np.cumsum(odd[at] & later)])
        odd_text = odd_before[bounds[1:]] > odd_before[first]
        heads = [names[i] for i in at[first].tolist()]
        for row, head in enumerate(heads):
            if bounds[row + 1] - first[row] > 1:  # a blank follows the head
                odd_text[row] |= not head or head[-1].isspace()
        found = [() if x is None else x for x in found]
        for row, head in enumerate(heads):
            found.append(self._pieces(texts[row].as_py() if odd_text[row] else head))
        at[first] = len(names) + np.arange(len(heads))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, sizes.sum())
        starts = np.cumsum(sizes) - sizes
        per_word = sizes[at]
        per_word[later & np.repeat(odd_text, np.diff(bounds))] = 0
        ends = np.cumsum(per_word)
        places = np.repeat(starts[at] - (ends - per_word), per_word)
        places += np.arange(len(places))
        offsets = np.concatenate([[0], ends])[bounds]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat[places]))


def _lists(rows: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    values = np.fromiter(chain.from_iterable(rows), np.int32, offsets[-1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


#: UTF-8 states: bytes still to come, and for the first of them the range it must lie in.
def _utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
    need, low, high = state
    if need:
        return (need - 1, 0x80, 0xBF) if low <= byte <= high else None
    if byte < 0x80:
        return (0, 0, 0)
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte <= 0xF4:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return None


def _utf8_run(data: bytes) -> tuple[int, int, int] | None:
    """The state after the bytes, None if they are not UTF-8."""
    state: tuple[int, int, int] | None = (0, 0, 0)
    for byte in data:
        state = _utf8_step(state, byte)
        if state is None:
            return None
    return state


class Decoder:
    """Token ids in, text out as soon as its characters are complete.

    The UTF-8 machine runs over the bytes of a token once for each state it is met in; the step
    of the whole token is kept. Bytes that are no UTF-8 become U+FFFD.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._steps: dict[tuple, tuple | None] = {}
        most = max(ranks.values()) + 1
        self._flags = np.zeros(most, np.int64)
        tokens: list[bytes | None] = [None] * most
        for token, rank in ranks.items():
            tokens[rank] = token
            self._flags[rank] = _utf8_run(token) == (0, 0, 0)
        self._table = pa.array(tokens, pa.binary())
        self._closed = {
            rank: token.decode("utf-8") if _utf8_run(token) == (0, 0, 0) else None
            for token, rank in ranks.items()
        }

    def data(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _step(self, state: tuple[int, int, int], token: int) -> tuple | None:
        """The state after the token, and where in it an open character begins (-1: before it)."""
        opened = -1
        for place, byte in enumerate(self.bytes_of[token]):
            if not state[0]:
                opened = place
            following = _utf8_step(state, byte)
            if following is None:
                return None
            state = following
        return state, opened

    def texts(self, rows: pa.ListArray) -> pa.StringArray:
        """The texts of many rows; rows of whole characters only are put together at once."""
        flat = rows.flatten()
        ids = flat.to_numpy(zero_copy_only=False)
        counts = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(rows), 0), out=counts[1:])
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self._table)):
            raise KeyError("unknown token id")
        taken = self._table.take(flat)  # the bytes of all tokens, one after the other
        if taken.null_count:
            raise KeyError("unknown token id")
        _, ends, data = taken.buffers()
        ends = np.frombuffer(ends, np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        found = pa.StringArray.from_buffers(
            len(rows), pa.py_buffer(ends[counts]), data if len(ids) else pa.py_buffer(b"")
        )
        changed = {
            row: self.text(ids[counts[row] : counts[row + 1]].tolist())
            for row in self._changed(ids, counts).tolist()
        }
        if not changed and rows.null_count == 0:
            return found
        valid = rows.is_valid().to_pylist()
        return pa.array(
            [
                (changed[i] if i in changed else found[i].as_py()) if valid[i] else None
                for i in range(len(rows))
            ],
            pa.string(),
        )

    def _changed(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Rows whose text is not just the bytes of the tokens. Whole characters need no machine; it
        runs over each different run of other tokens once."""
        opened = np.flatnonzero(self._flags[ids] == 0)
        row = np.searchsorted(counts, opened, side="right") - 1
        first = np.flatnonzero((np.diff(opened, prepend=-9) > 1) | (np.diff(row, prepend=-1) > 0))
        size = np.diff(np.append(first, len(opened)))
        short = (size <= 4) if len(self._table) < 1 << 16 else np.zeros(len(size), bool)
        codes = np.zeros(int(short.sum()), np.uint64)
        for place in range(4):
            more = np.flatnonzero(size[short] > place)
            token = ids[opened[first[short][more]] + place].astype(np.uint64) + np.uint64(1)
            codes[more] |= token << np.uint64(16 * place)
        different, which = np.unique(codes, return_inverse=True)
        runs = [[(c >> s & 0xFFFF) - 1 for s in (0, 16, 32, 48) if c >> s] for c in different.tolist()]
        same = np.array([self._same(r) for r in runs], bool)
        bad = [row[first[short][~same[which]]]] if len(runs) else [row[:0]]
        for at, n in zip(first[~short].tolist(), size[~short].tolist(), strict=True):
            if not self._same(ids[opened[at] : opened[at] + n].tolist()):
                bad.append(row[at : at + 1])
        return np.unique(np.concatenate(bad))

    def _same(self, tokens: list[int]) -> bool:
        return "".join(self.stream(tokens)).encode() == self.data(tokens)

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        state, held = (0, 0, 0), b""
        for token in ids:
            key = (state, token)
            if key not in self._steps:
                self._steps[key] = self._step(state, token)
            step, whole = self._steps[key], held + self.bytes_of[token]
            if step is None:
                # a last byte or three may still begin a character
                tails = (n for n in range(1, min(3, len(whole)) + 1) if _begins(whole[-n:]))
                cut = len(whole) - next(tails, 0)
                state = _utf8_run(whole[cut:]) or (0, 0, 0)
            else:
                state, opened = step
                if not state[0]:
                    cut = len(whole)
                else:
                    cut = 0 if opened < 0 else len(held) + opened
            if cut:
                yield whole[:cut].decode("utf-8", "replace")
            held = whole[cut:]
        if held:
            yield held.decode("utf-8", "replace")

    def text(self, ids: list[int]) -> str:
        """All of it at once; runs of tokens that are whole characters need no machine."""
        parts = [self._closed[i] for i in ids]
        if None not in parts:
            return "".join(parts)
        out, at, n = [], 0, len(ids)
        while at < n:
            if parts[at] is not None:
                out.append(parts[at])
                at += 1
                continue
            end = at + 1
            while end < n and parts[end] is None:
                end += 1
            out.append("".join(self.stream(ids[at:end])))
            at = end
        return "".join(out)


def _begins(data: bytes) -> bool:
    """Whether the bytes begin one character that more bytes can complete."""
    state = _utf8_run(data)
    return state is not None and state[0] > 0 and not 0x80 <= data[0] <= 0xBF


@lru_cache(maxsize=2)
def _encoder(data: bytes, pattern: str, blanks_split: bool) -> Encoder:
    return Encoder(parse_ranks(data), pattern, blanks_split)


@lru_cache(maxsize=2)
def _decoder(data: bytes) -> Decoder:
    return Decoder(parse_ranks(data))


def _slices(batch: pa.RecordBatch, sizes: Iterable[int], most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose sizes add up to about ``most``."""
    start = total = 0
    for row, size in enumerate(sizes):
        if row > start and total + size > most:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def _sized(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    lengths = pa.compute.fill_null(_lengths(batch.column(column)), 0)
    return _slices(batch, lengths.to_pylist(), most)


def _lengths(column: pa.Array) -> pa.Array:
    if pa.types.is_list(column.type):
        return pa.compute.list_value_length(column)
    return pa.compute.binary_length(column)


def encode(
    docs: DataFrame,
    ranks: bytes,
    pattern: str,
    blanks_split: bool = False,
    text_col: str = "text",
    ids_col: str = "token_ids",
    decoded_col: str | None = None,
) -> DataFrame:
    """Adds the token ids of the text, and with ``decoded_col`` the text decoded from them in the
    same worker. ``ranks``: the content of a rank file."""
    source = with_columns(docs, _text=text_of(text_col))
    added = [T.StructField("_ids", T.ArrayType(T.IntegerType()))]
    if decoded_col:
        added.append(T.StructField("_out", T.StringType()))
    rest = source.columns[:-1]
    out = T.StructType([*source.schema.fields[:-1], *added])
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a rank file: about a MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern, blanks_split)
        decoder = _decoder(shared.value) if decoded_col else None
        for whole in batches:
            for batch in _sized(whole, "_text", 3 * BATCH_TOKENS):
                ids = encoder.batch(batch.column("_text"))
                columns = [*[batch.column(name) for name in rest], ids]
                if decoder:
                    columns.append(decoder.texts(ids))
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    encoded = source.mapInArrow(run, out)
    values = {ids_col: F.col("_ids")} | ({decoded_col: F.col("_out")} if decoded_col else {})
    return with_columns(encoded, **values).drop("_ids", "_out")


def decode(
    docs: DataFrame,
    ranks: bytes,
    ids_col: str = "token_ids",
    text_col: str = "decoded",
) -> DataFrame:
    """Adds the text of the token ids; NULL for NULL. An unknown id is an error."""
    source = with_columns(docs, _ids=F.col(ids_col).cast("array<int>"))
    out = T.StructType([*source.schema.fields, T.StructField("_out", T.StringType())])
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(shared.value)
        for whole in batches:
            for batch in _sized(whole, "_ids", BATCH_TOKENS):
                names = [*batch.schema.names, "_out"]
                column = decoder.texts(batch.column("_ids"))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], names=names)

    decoded = source.mapInArrow(run, out)
    return with_columns(decoded.drop("_ids"), **{text_col: F.col("_out")}).drop("_out")
