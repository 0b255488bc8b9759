"""Chat formatting by compiled templates (operator 11).

A template is text with ``{{ expression }}``, ``{% for turn in turns %}``, ``{% if %} {% elif %} {% else %}``, ``{% generation %}``
(what a model is to learn) and ``{# comments #}``. It is parsed into a tree, constants are folded (given values are
constants; branches that can't be taken go, neighbouring texts become one), and the tree becomes Python closures.
The language is closed: names are the turn, ``loop`` and given values, fields and filters are listed below, there are no
calls, no loops but that over the turns, and types are checked when it is compiled, so rendering can't fail on data.

Texts are escaped where they are put out. ``marks`` are the template's control strings. A backslash becomes two, and
``\\-``, which stands for nothing, breaks each mark inside a text after its first character and follows a text that ends
like the start of a mark. So a mark in the output is always the template's own, whatever stands beside a text, and
``unescaped`` gives back the text.

Conversations are shuffled by id, sorted by turn and rendered turn by turn; a long one comes out in several parts, each
of whole turns, so no task holds a conversation. (Its digests need its turns in order, so one task reads them.)

Results for special input: null texts and roles are empty; turns of equal number go by role, then text, null first; a
null conversation id is one conversation; repeated rows are turns of their own; other columns are left out; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A turn's fields and what ``loop`` has, with their types.
FIELDS = {"turn": {"role": str, "text": str}, "loop": {"first": bool, "last": bool, "index": int}}
FILTERS: dict[str, tuple[Callable, type]] = {"trim": (str.strip, str), "upper": (str.upper, str), "lower": (str.lower, str), "length": (len, int)}
MOST_SOURCE, MOST_DEPTH = 20_000, 40
#: A part ends after the turn with which it has so many characters.
PART = 1_000_000

#: Known roles have a head of their own, others are written out. Only what assistants say is learned.
MARKS = ("### System: ", "### User: ", "### Assistant: ", "### Turn: ", "</role>", "</turn>")
PLAIN = (
    '{% for turn in turns %}{% if turn.role == "assistant" %}{{ head ~ "Assistant: " }}{% generation %}{{ turn.text }}{% endgeneration %}'
    '{% elif turn.role == "user" %}{{ head ~ "User: " }}{{ turn.text }}{% elif turn.role == "system" %}{{ head ~ "System: " }}{{ turn.text }}'
    '{% else %}{{ head ~ "Turn: " }}{{ turn.role }}</role>{{ turn.text }}{% endif %}</turn>{# one line more for people #}\n{% endfor %}'
)
GIVEN = {"head": "### "}
_TURN = re.compile(r"### (?:(System|User|Assistant): |Turn: (.*?)</role>)(.*?)</turn>\n", re.S)


class TemplateError(ValueError):
    """A template that isn't of the language, or that could make a mark out of its own texts."""


@dataclass(frozen=True)
class Const:
    value: str | int | bool


@dataclass(frozen=True)
class Field:
    of: str
    name: str
    kind: type


@dataclass(frozen=True)
class Op:
    """``or and not == != in ~`` or a filter, on one or two operands."""

    name: str
    args: tuple
    kind: type


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition, body)


@dataclass(frozen=True)
class Block:
    """``for`` or ``generation``."""

    name: str
    body: tuple


def kind(e) -> type:
    return type(e.value) if isinstance(e, Const) else e.kind


def shown(v) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


#: What operators do with values.
ACTIONS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b, "~": lambda a, b: shown(a) + shown(b), "not": lambda a: not a}
ACTIONS |= {"or": lambda a, b: a or b, "and": lambda a, b: a and b} | {name: f for name, (f, _) in FILTERS.items()}

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_WORD = re.compile(r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d{1,9})\b|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[~|.()]))""", re.S)


class _Expression:
    """A parser of one expression; loosest first: or, and, not, comparison, ~, filters."""

    def __init__(self, source: str, given: dict, turn: str | None):
        self.words, at, source = [], 0, source.rstrip()
        while at < len(source):
            if not (m := _WORD.match(source, at)):
                raise TemplateError(f"not an expression: {source[at:]!r}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.given, self.turn, self.depth = given, turn, 0

    def whole(self):
        e = self.either()
        if self.words:
            raise TemplateError(f"not expected: {self.words[0][1]!r}")
        return e

    def takes(self, *words: str) -> str | None:
        return self.words.pop(0)[1] if self.words and self.words[0][0] != "text" and self.words[0][1] in words else None

    def either(self):
        return self._chain(("or",), lambda: self._chain(("and",), self.negated, bool), bool)

    def _chain(self, names: tuple, operand: Callable, wanted: type | None):
        e = operand()
        while name := self.takes(*names):
            e = self._op(name, (e, operand()), wanted)
        return e

    def negated(self):
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise TemplateError("nested too deeply")
        e = self._op("not", (self.negated(),), bool) if self.takes("not") else self.compared()
        self.depth -= 1
        return e

    def compared(self):
        e = self._chain(("~",), self.filtered, None)
        if name := self.takes("==", "!=", "in"):
            e = self._op(name, (e, self._chain(("~",), self.filtered, None)), str if name == "in" else None)
        return e

    def filtered(self):
        e = self.single()
        while self.takes("|"):
            group, name = self.words.pop(0) if self.words else ("", "")
            if name not in FILTERS:
                raise TemplateError(f"no filter: {name!r}")
            e = self._op(name, (e,), str)
        return e

    def _op(self, name: str, args: tuple, wanted: type | None):
        if (wanted and any(kind(a) is not wanted for a in args)) or (name in ("==", "!=") and kind(args[0]) is not kind(args[1])):
            raise TemplateError(f"{name} of {' and '.join(kind(a).__name__ for a in args)}")
        return Op(name, args, FILTERS[name][1] if name in FILTERS else str if name == "~" else bool)

    def single(self):
        group, word = self.words.pop(0) if self.words else ("", "its end")
        if group == "text":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1], flags=re.S))
        if group == "number":
            return Const(int(word))
        if word == "(":
            e = self.either()
            if not self.takes(")"):
                raise TemplateError("a bracket isn't closed")
            return e
        if word in ("true", "false"):
            return Const(word == "true")
        if group == "name" and word in self.given:
            return Const(self.given[word])
        if group == "name" and self.turn and word in (self.turn, "loop") and self.takes("."):
            of, name = "loop" if word == "loop" else "turn", self.words.pop(0)[1] if self.words else ""
            if name in FIELDS[of]:
                return Field(of, name, FIELDS[of][name])
            word = f"{word}.{name}"
        raise TemplateError(f"not known here: {word!r}")


def parse(source: str, given: dict | None = None) -> tuple:
    """The tree of a template."""
    if len(source) > MOST_SOURCE:
        raise TemplateError("the template is too long")
    given, body, turn = given or {}, [], None
    held: list[list] = []  # blocks that aren't closed: [name, body outside, branches]
    at = 0
    for m in [*_TAG.finditer(source), None]:
        if text := source[at : m.start() if m else None]:
            body.append(Output(Const(text)))
        if not m:
            break
        at = m.end()
        if m[1] is not None:
            body.append(Output(_Expression(m[1], given, turn).whole()))
            continue
        word, _, rest = (m[2] or "").strip().partition(" ")
        if word == "if":
            held.append(["if", body, [], _Expression(rest, given, turn).whole()])
            body = []
        elif word in ("elif", "else") and held and held[-1][0] == "if" and held[-1][3] is not None:
            held[-1][2].append((held[-1][3], tuple(body)))
            held[-1][3] = _Expression(rest, given, turn).whole() if word == "elif" else None
            body = []
        elif word == "endif" and held and held[-1][0] == "if":
            _, outside, branches, last = held.pop()
            branches.append((Const(True) if last is None else last, tuple(body)))
            if any(kind(c) is not bool for c, _ in branches):
                raise TemplateError("a condition isn't true or false")
            outside.append(If(tuple(branches)))
            body = outside
        elif word == "for" and turn is None and (f := re.fullmatch(r"([A-Za-z_]\w*) in turns", rest.strip())):
            turn = f[1]
            held.append(["for", body])
            body = []
        elif word == "generation" and not any(h[0] == "generation" for h in held):
            held.append(["generation", body])
            body = []
        elif word in ("endfor", "endgeneration") and held and held[-1][0] == word[3:]:
            name, outside = held.pop()
            outside.append(Block(name, tuple(body)))
            body = outside
            turn = None if name == "for" else turn
        elif m[2] is not None:
            raise TemplateError(f"not expected: {m[0]!r}")
        if len(held) > MOST_DEPTH:
            raise TemplateError("nested too deeply")
    if held:
        raise TemplateError(f"{held[-1][0]} isn't closed")
    return tuple(body)


def folded(e):
    """An expression with its constant parts worked out."""
    if not isinstance(e, Op):
        return e
    args = tuple(map(folded, e.args))
    if all(isinstance(a, Const) for a in args):
        return Const(ACTIONS[e.name](*(a.value for a in args)))
    if e.name in ("or", "and"):
        for a, other in (args, args[::-1]):
            if isinstance(a, Const):
                return a if a.value == (e.name == "or") else other
    return Op(e.name, args, e.kind)


def fold(body: tuple) -> tuple:
    """The tree without constant expressions, branches that can't be taken, and neighbouring texts."""
    out: list = []
    for s in body:
        if isinstance(s, Output):
            new = (Output(folded(s.value)),)
        elif isinstance(s, Block):
            new = (Block(s.name, fold(s.body)),)
        else:
            branches = []
            for condition, inner in s.branches:
                condition = folded(condition)
                if condition != Const(False):
                    branches.append((condition, fold(inner)))
                if condition == Const(True):
                    break
            new = branches[0][1] if branches and branches[0][0] == Const(True) else (If(tuple(branches)),) if branches else ()
        for n in new:
            if isinstance(n, Output) and isinstance(n.value, Const) and out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                out[-1] = Output(Const(shown(out[-1].value.value) + shown(n.value.value)))
            else:
                out.append(n)
    return tuple(out)


class _Sink:
    """Output since the last part, and what of it is learned, counted from the conversation's start."""

    def __init__(self):
        self.texts, self.start, self.end, self.learned = [], 0, 0, []

    def put(self, text: str) -> None:
        self.texts.append(text)
        self.end += len(text)

    def cut(self) -> tuple[int, str, list]:
        part = self.start, "".join(self.texts), self.learned
        self.texts, self.start, self.learned = [], self.end, []
        return part


class Template:
    """A compiled template."""

    def __init__(self, source: str, marks: tuple[str, ...], given: dict | None = None):
        if any(not m or "\\" in m for m in marks):
            raise TemplateError("a mark is some text without backslashes")
        self._mark = re.compile(f"(?=(?:{'|'.join(map(re.escape, marks))}))(.)", re.S) if marks else None
        self._begun = tuple(sorted({m[:i] for m in marks for i in range(1, len(m))}))
        self.tree = fold(parse(source, given))
        self._steps = [(s, None if s == Block("for", getattr(s, "body", None)) else self._statement(s)) for s in self.tree]
        self._bodies = {id(s): self._all(s.body) for s, f in self._steps if f is None}

    def escaped(self, text: str) -> str:
        """The text with no mark in it."""
        if "\\" in text:
            text = text.replace("\\", "\\\\")
        if self._mark:
            text = self._mark.sub(r"\1\\-", text)
        return text + "\\-" if self._begun and text.endswith(self._begun) else text

    def _all(self, body: tuple) -> Callable:
        steps = [self._statement(s) for s in body]

        def run(env, out):
            for f in steps:
                f(env, out)

        return run

    def _statement(self, s) -> Callable:
        if isinstance(s, Output):
            if isinstance(s.value, Const):
                text = shown(s.value.value)
                if "\\" in text or (self._begun and text.endswith(self._begun)):
                    raise TemplateError(f"this text holds a backslash or ends like the start of a mark: {text!r}")
                return lambda env, out: out.put(text)
            value, escaped = self._value(s.value), self.escaped
            return lambda env, out: out.put(escaped(shown(value(env))))
        if isinstance(s, If):
            branches = [(self._value(c), self._all(b)) for c, b in s.branches]

            def choose(env, out):
                for condition, body in branches:
                    if condition(env):
                        return body(env, out)

            return choose
        if s.name == "for":
            raise TemplateError("the loop over the turns stands alone, in no other block")
        body = self._all(s.body)

        def learn(env, out):
            start = out.end
            body(env, out)
            out.learned.append((start, out.end))

        return learn

    def _value(self, e) -> Callable:
        if isinstance(e, Const):
            return lambda env, v=e.value: v
        if isinstance(e, Field):
            return lambda env, of=e.of, name=e.name: env[of][name]
        args = [self._value(a) for a in e.args]
        if e.name == "or":
            return lambda env, a=args[0], b=args[1]: a(env) or b(env)
        if e.name == "and":
            return lambda env, a=args[0], b=args[1]: a(env) and b(env)
        if len(args) == 1:
            return lambda env, f=ACTIONS[e.name], a=args[0]: f(a(env))
        return lambda env, f=ACTIONS[e.name], a=args[0], b=args[1]: f(a(env), b(env))

    def render(self, turns: Iterator[tuple[str, str]], part: int = PART) -> Iterator[tuple[int, str, list]]:
        """Parts of a conversation: where each starts, its text, and the ranges in the conversation that are learned."""
        out, env = _Sink(), {}
        for s, step in self._steps:
            if step:
                step(env, out)
                continue
            body, turns = self._bodies[id(s)], iter(turns)
            this, index = next(turns, None), 0
            while this is not None:
                after, index = next(turns, None), index + 1
                body({"turn": {"role": this[0], "text": this[1]}, "loop": {"first": index == 1, "last": after is None, "index": index}}, out)
                if out.end - out.start >= part and after is not None:
                    yield out.cut()
                this = after
        yield out.cut()


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "" if m[1] == "-" else m[1], text, flags=re.S) if "\\" in text else text


@lru_cache(maxsize=8)
def compiled(source: str, marks: tuple[str, ...], given: tuple) -> Template:
    """One for each Python worker."""
    return Template(source, marks, dict(given))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(0, b.num_rows, 512):
            yield from zip(*(c.to_pylist() for c in b.slice(i, 512).columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of some four million characters, 4,096 rows at most."""
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += size(r)
        if len(held) == 4096 or chars > 4 * PART:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def format(turns: DataFrame, source: str = PLAIN, marks: tuple[str, ...] = MARKS, given: dict | None = None, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part: int = PART) -> DataFrame:
    """The conversations' parts: id, number of the part, where it starts, its text, and what is learned (code points of the conversation).

    The rows of a task are in order of conversation and part.
    """
    given = tuple(sorted((GIVEN if given is None else given).items()))
    compiled(source, marks, given)  # a wrong template fails here
    kind = turns.schema[conv].dataType.simpleString()
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, first = compiled(source, marks, given), next(batches, None)
        if first is None:
            return

        def all_parts():
            for key, group in groupby(_rows(_chained(first, batches)), key=lambda r: r[0]):
                for k, (start, out, learned) in enumerate(template.render(((r[2] or "", r[3] or "") for r in group), part)):
                    yield key, k, start, out, [{"start": i, "end": j} for i, j in learned]

        schema = pa.schema([("conv_id", first.schema.field(0).type), ("part", pa.int32()), ("start", pa.int64()), ("formatted", pa.string()), ("learned", _SPANS)])
        yield from _batches(all_parts(), schema, lambda r: len(r[3]))

    return rows.mapInArrow(work, f"conv_id {kind}, part int, start long, formatted string, learned array<struct<start:long,end:long>>")


def _chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a part that ``PLAIN`` made."""
    at = 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}: {formatted[at : at + 40]!r}")
        yield m[1].lower() if m[1] else unescaped(m[2]), unescaped(m[3])
        at = m.end()


def turns(formatted: DataFrame) -> DataFrame:
    """The turns that the parts hold: conversation, part, number in the part, role and text."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([b.schema.field(0), ("part", pa.int32()), ("number", pa.int32()), ("role", pa.string()), ("text", pa.string())])
            found = ((conv, part, i, *t) for conv, part, text in _rows(iter([b])) for i, t in enumerate(read_turns(text)))
            yield from _batches(found, schema, lambda r: len(r[4]))

    return formatted.select("conv_id", "part", "formatted").mapInArrow(work, f"conv_id {kind}, part int, number int, role string, text string")


def digests(formatted: DataFrame, *, in_order: bool = False) -> DataFrame:
    """For each conversation, read back from its parts: turns and learned text as digests, and sizes.

    ``in_order`` says that a task holds all parts of its conversations in order, as ``format`` gives them.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    parts = formatted.select("conv_id", "part", "start", "formatted", "learned")
    if not in_order:
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def found():
            for key, group in groupby(_rows(_chained(first, batches)), key=lambda r: r[0]):
                whole, loss, n, learned_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for _, _, start, text, learned in group:
                    chars += len(text)
                    for role, said in read_turns(text):
                        n += 1
                        whole.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    for span in learned:
                        said = unescaped(text[span["start"] - start : span["end"] - start])
                        learned_chars += len(said)
                        loss.update(said.encode("utf-8", "surrogatepass"))
                yield key, n, whole.hexdigest(), learned_chars, loss.hexdigest(), chars

        longs, texts = pa.int64(), pa.string()
        schema = pa.schema([("conv_id", first.schema.field(0).type), ("n_turns", longs), ("turns_sha256", texts), ("loss_chars", longs), ("loss_sha256", texts), ("formatted_chars", longs)])
        yield from _batches(found(), schema, lambda r: 0)

    return parts.mapInArrow(work, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def oracle(extra: list[tuple[int, int, str, str]]) -> str:
    """The digests as SQL, over conversations and some rows more. An escape adds one character for each backslash and two for each mark or begun mark."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    begun = sorted({m[:i] for m in MARKS for i in range(1, len(m))})

    def size(c: str) -> str:
        found = " + ".join(f"2 * (length({c}) - length(replace({c}, {q(m)}, ''))) // {len(m)}" for m in MARKS)
        return f"(length({c}) + length({c}) - length(replace({c}, '\\', '')) + {found} + CASE WHEN {' OR '.join(f'ends_with({c}, {q(b)})' for b in begun)} THEN 2 ELSE 0 END)"

    rows = " UNION ALL ".join(["SELECT conv_id, turn, role, text FROM conversations", *(f"SELECT {c}, {t}, {q(r)}, {q(x)}" for c, t, r, x in extra)])
    order = "ORDER BY turn NULLS FIRST, raw_role NULLS FIRST, raw_text NULLS FIRST"
    return f"""
    WITH t AS (SELECT conv_id, turn, role AS raw_role, text AS raw_text, coalesce(role, '') AS role, coalesce(text, '') AS text FROM ({rows}))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' {order}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        sum({size("text")} + length('</turn>') + 1 + CASE role WHEN 'assistant' THEN length('### Assistant: ') WHEN 'user' THEN length('### User: ')
            WHEN 'system' THEN length('### System: ') ELSE length('### Turn: ') + {size("role")} + length('</role>') END)::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id"""
