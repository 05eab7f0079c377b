"""Chat formatting: a role state machine over turns, and a declarative template.

The template says for each role what opens and closes a turn and whether its
text is learned. Formatting walks the turns of a conversation through a finite
state machine that tells whether their order is valid and emits text segments,
each with a loss flag. Control strings inside texts are escaped reversibly: a
backslash goes after the first character of each, and backslashes are doubled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import keep

#: Characters of a part of a formatted conversation.
PART = 1 << 18


@dataclass(frozen=True)
class Template:
    """``opening`` and ``closing`` surround each turn; ``{role}`` stands for the turn's role."""

    opening: str = "<|im_start|>{role}\n"
    closing: str = "<|im_end|>\n"
    learned: frozenset[str] = frozenset({"assistant"})
    #: Strings that no text may contain unescaped, the template's own and those of common other ones.
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    #: state -> role -> next state. A conversation is valid if it never lacks a move and ends in ``final``.
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: frozenset[str] = frozenset({"asked", "answered"})


class Formatter:
    def __init__(self, template: Template = Template()):
        self.template = template
        control = "|".join(map(re.escape, sorted(template.control, key=len, reverse=True)))
        self._escape = re.compile(rf"\\|{control}")
        start, between = template.opening.split("{role}")
        self._turn = re.compile(
            rf"{re.escape(start)}((?:\\.|[^\\\n])*+){re.escape(between)}(.*?){re.escape(template.closing)}", re.DOTALL
        )

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def segments(self, turns: Iterable[tuple[str, str]]) -> Iterator[tuple[str, bool]]:
        """(text, learned) segments of turns (role, text); joined they are the formatted conversation."""
        for role, text in turns:
            # A line feed would end the role's line: there it is escaped as well.
            yield self.template.opening.format(role=self.escape(role).replace("\n", "\\\n")), False
            yield self.escape(text), role in self.template.learned
            yield self.template.closing, False

    def state(self, state: str | None, role: str) -> str | None:
        return self.template.moves.get(state, {}).get(role) if state else None

    def turns(self, formatted: str) -> Iterator[tuple[str, str, int]]:
        """Whole turns (role, text, end) at the head of a formatted text, one right after the other."""
        at = 0
        while match := self._turn.match(formatted, at):
            at = match.end()
            yield self.unescape(match[1]), self.unescape(match[2]), at


class Writer:
    """One conversation's training text, as parts of about ``PART`` characters with their loss mask.

    A part is (text, runs): the mask as lengths of runs that are in turn without
    and with loss. Parts are cut anywhere, also within a turn or an escape.
    """

    def __init__(self, formatter: Formatter):
        self.formatter, self.state, self.turn, self.bad_turn = formatter, "start", 0, None
        self.held: list[tuple[str, bool]] = []
        self.size = 0

    def add(self, role: str, text: str) -> None:
        self.state = self.formatter.state(self.state, role)
        if self.state is None and self.bad_turn is None:
            self.bad_turn = self.turn
        self.turn += 1
        for piece, loss in self.formatter.segments([(role, text)]):
            self.held.append((piece, loss))
            self.size += len(piece)

    def parts(self, end: bool = False) -> Iterator[tuple[str, list[int]]]:
        """The whole parts so far; at the end also the rest."""
        if self.size < PART and not end:
            return
        text = "".join(piece for piece, _ in self.held)
        ends, learned, at = [], [], 0
        for piece, loss in self.held:
            at += len(piece)
            ends.append(at), learned.append(loss)
        stop = len(text) if end else len(text) - len(text) % PART
        k = 0
        for low in range(0, stop, PART):
            high, runs, now, loss = min(low + PART, stop), [0], low, False
            while now < high:
                while ends[k] <= now:
                    k += 1
                if learned[k] != loss:
                    runs.append(0)
                    loss = learned[k]
                runs[-1] += min(ends[k], high) - now
                now = min(ends[k], high)
            yield text[low:high], runs
        rest = [(text[max(stop, e - len(piece)) : e], loss) for (piece, loss), e in zip(self.held, ends, strict=True) if e > stop]
        self.held, self.size = rest, len(text) - stop

    def verdict(self) -> tuple[bool, int | None]:
        return self.state in self.formatter.template.final, self.bad_turn


class Reader:
    """Reads a conversation back from nothing but its parts, and digests what it finds.

    Turns are parted by the template's strings alone, the learned text by the
    mask alone. It holds the turn that is not yet whole, no more.
    """

    def __init__(self, formatter: Formatter):
        self.formatter, self.n_turns, self.loss_chars, self.formatted_chars = formatter, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.held, self.open_escape, self.looked = "", "", 0

    def _learn(self, text: str) -> None:
        text = self.open_escape + text
        tail = len(text) - len(text.rstrip("\\"))
        self.open_escape = "\\" if tail % 2 else ""  # its other half is in the next run
        clear = self.formatter.unescape(text[: len(text) - tail % 2])
        self.loss_chars += len(clear)
        self.loss.update(clear.encode("utf-8", "surrogatepass"))

    def add(self, text: str, runs: list[int]) -> None:
        at = 0
        for k, n in enumerate(runs):
            if k % 2:
                self._learn(text[at : at + n])
            at += n
        self.formatted_chars += len(text)
        self.held += text
        # A closing string is whole only with what was read before it: look a little further back.
        if self.held.find(self.formatter.template.closing, max(0, self.looked - len(self.formatter.template.closing))) >= 0:
            end = 0
            for role, said, end in self.formatter.turns(self.held):
                self.n_turns += 1
                self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            self.held = self.held[end:]
        self.looked = len(self.held)

    def row(self) -> tuple:
        if self.held or self.open_escape:
            raise ValueError("a formatted conversation ends within a turn")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


PARTS = "conv_id long, part long, text string, runs array<long>, valid boolean, bad_turn long"
RESULT = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, bad_turn long"
)
TURNS = "conv_id long, turn long, role string, text string"
_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields]
    )


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def formatted(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """The training text of all conversations (conv_id, turn, role, text): conv_id, part, text, runs, valid, bad_turn.

    Joined in order of ``part``, the texts of a conversation are its formatted
    form; ``runs`` is the loss mask, see :class:`Writer`. Turns go by number,
    equal ones by role and text; repeated rows are turns each. A null role or
    text is empty, a null conv_id a conversation of its own. An order of roles
    that the state machine has no move for is formatted all the same; ``valid``
    is false then and ``bad_turn`` the first turn without a move, from 0 (both
    stand in the last part, and are null in those before). A conversation is
    read as a sorted stream, of which one part and one turn are in memory. Other
    columns are ignored; an empty table gives no rows.
    """
    formatter = Formatter(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, now, part, rows, size = None, None, 0, [], 0

        def take(end: bool = False) -> None:
            nonlocal part, size
            for text, runs in writer.parts(end):
                rows.append([now, part, text, runs, None, None])
                part, size = part + 1, size + len(text)
            if end:
                rows[-1][4:] = writer.verdict()

        for batch in batches:
            for conv, _, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if writer is None or now != conv:
                    if writer is not None:
                        take(True)
                    writer, now, part = Writer(formatter), conv, 0
                writer.add(role, text)
                take()
                # The last part says whether the order is valid: it stays until the conversation ends.
                if size > 4 * PART and len(rows) > 1:
                    yield _batch(rows[:-1], PARTS)
                    del rows[:-1]
                    size = len(rows[0][2])
        if writer is not None:
            take(True)
        if rows:
            yield _batch(rows, PARTS)

    return _ordered(conversations).mapInArrow(run, PARTS)


def read_back(parts: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation of :func:`formatted`'s table, from its texts and masks alone; an empty table gives no rows."""
    formatter = Formatter(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now, verdict, done = None, None, (None, None), []
        for batch in batches:
            for conv, _, text, runs, *said in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if reader is None or now != conv:
                    if reader is not None:
                        done.append((now, *reader.row(), *verdict))
                    reader, now = Reader(formatter), conv
                reader.add(text, runs)
                verdict = said
            if done:
                yield _batch(done, RESULT)
                done = []
        if reader is not None:
            yield _batch([(now, *reader.row(), *verdict)], RESULT)

    ordered = parts.select([f.split(" ")[0] for f in PARTS.split(", ")]).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(run, RESULT)


def format_digest(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Write the formatted conversations, and describe each as read back from what was written."""
    return read_back(keep(formatted(conversations, template), "formatted"), template)
