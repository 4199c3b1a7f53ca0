"""Chat formatting by a small template language, compiled to Python closures.

The language: ``{{ expression }}`` writes a value, ``{% for x in list %}…{% endfor %}``,
``{% if e %}…{% elif e %}…{% else %}…{% endif %}``, ``{% set x = e %}`` and
``{% generation %}…{% endgeneration %}`` around what a model has to produce. Expressions have
strings, whole numbers, ``true false none``, names, ``a.b`` and ``a['b']`` on mappings,
``+ == != and or not``, parentheses and filters ``|upper |lower |trim |length |escape |escape_line``.
There are no calls, no attributes of Python objects, no loops but over a given list and no
import: a template can neither reach the interpreter nor run forever.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


class TemplateError(ValueError):
    """A template that cannot be compiled, or a value that does not fit it."""


# ---- syntax tree

@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Write:
    value: object


@dataclass(frozen=True)
class Loop:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Branch:
    test: object
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


_PARTS = re.compile(r"\{\{-?\s*(?P<write>.*?)\s*-?\}\}|\{%-?\s*(?P<do>.*?)\s*-?%\}|\{#.*?#\}", re.S)
_TOKENS = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|[+.|()\[\]]))""", re.S)
_ESCAPED = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                raise TemplateError(f"unexpected {text[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def whole(self):
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def chain(self, op: str, below: Callable):
        out = below()
        while self.take(op):
            out = Op(op, (out, below()))
        return out

    def either(self):
        return self.chain("or", lambda: self.chain("and", self.negated))

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        out = self.chain("+", self.filtered)
        op = self.take("==", "!=")
        return Op(op, (out, self.chain("+", self.filtered))) if op else out

    def filtered(self):
        out = self.value()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            self.at += 1
            out = Op("|" + name, (out,))
        return out

    def value(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        if self.take("("):
            out = self.either()
            if not self.take(")"):
                raise TemplateError("a parenthesis is not closed")
        else:
            kind, token = self.tokens[self.at]
            self.at += 1
            if kind == "text":
                out = Const(re.sub(r"\\(.)", lambda m: _ESCAPED.get(m[1], m[1]), token[1:-1], flags=re.S))
            elif kind == "number":
                out = Const(int(token))
            elif kind == "name":
                known = {"true": True, "false": False, "none": None}
                out = Const(known[token]) if token in known else Name(token)
            else:
                raise TemplateError(f"unexpected {token!r}")
        while True:
            if self.take("."):
                kind, token = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "name":
                    raise TemplateError("a name must follow a dot")
                self.at += 1
                out = Item(out, Const(token))
            elif self.take("["):
                out = Item(out, self.either())
                if not self.take("]"):
                    raise TemplateError("a bracket is not closed")
            else:
                return out


def parse(template: str) -> tuple:
    """The syntax tree of a template."""
    root: list = []
    stack: list[tuple[str, list, list]] = [("", root, [])]  # what closes it, nodes, header
    at = 0
    for m in _PARTS.finditer(template):
        nodes = stack[-1][1]
        if m.start() > at:
            nodes.append(Write(Const(template[at : m.start()])))
        at = m.end()
        if m["write"] is not None:
            nodes.append(Write(_Expression(m["write"]).whole()))
        elif m["do"] is not None:
            _statement(m["do"], stack)
    if at < len(template):
        stack[-1][1].append(Write(Const(template[at:])))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is missing")
    return tuple(root)


def _statement(text: str, stack: list) -> None:
    word, _, rest = text.partition(" ")
    close, nodes, head = stack[-1]
    if word == "for":
        m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
        if not m:
            raise TemplateError(f"cannot read {text!r}")
        stack.append(("endfor", [], ["for", m[1], _Expression(m[2]).whole()]))
    elif word == "if":
        stack.append(("endif", [], ["if", [(_Expression(rest).whole(), None)]]))
    elif word in ("elif", "else") and close == "endif" and head[1][-1][0] is not None:
        head[1][-1] = (head[1][-1][0], tuple(nodes))
        head[1].append((_Expression(rest).whole() if word == "elif" else None, None))
        stack[-1] = (close, [], head)
    elif word == "set":
        m = re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest.strip(), re.S)
        if not m:
            raise TemplateError(f"cannot read {text!r}")
        nodes.append(Assign(m[1], _Expression(m[2]).whole()))
    elif word == "generation":
        stack.append(("endgeneration", [], ["generation"]))
    elif word == close and len(stack) > 1:
        stack.pop()
        body = tuple(nodes)
        if head[0] == "for":
            node = Loop(head[1], head[2], body)
        elif head[0] == "generation":
            node = Generation(body)
        else:
            parts, no = [*head[1][:-1], (head[1][-1][0], body)], ()
            for test, nodes_of in reversed(parts):
                no = nodes_of if test is None else (Branch(test, nodes_of, no),)
            node = no[0]
        stack[-1][1].append(node)
    else:
        raise TemplateError(f"unexpected {text!r}")


# ---- values

#: What opens a control string; a text's own are escaped by a backslash before them.
CONTROLS = ("### ", "</turn>")
_CONTROL = re.compile(r"\\|### |</turn>")


def escape(text: str) -> str:
    """A backslash before every backslash and control string; ``unescape`` takes them off."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _text(value: object) -> str:
    if value is None:
        return ""
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


#: Filters by name.
FILTERS: dict[str, Callable] = {
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "trim": lambda v: _text(v).strip(),
    "length": lambda v: len(v) if isinstance(v, (str, list, tuple, dict)) else 0,
    "escape": lambda v: escape(_text(v)),
    "escape_line": lambda v: escape(_text(v)).replace("\n", "\\\n"),
}


def _plus(a, b):
    both = isinstance(a, int) and isinstance(b, int) and not isinstance(a, bool) and not isinstance(b, bool)
    return a + b if both else _text(a) + _text(b)


_OPS: dict[str, Callable] = {"+": _plus, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "not": lambda a: not a}


def fold(node):
    """The tree with constant expressions, branches and neighbouring constant texts folded."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Write) and isinstance(y.value, Const):
                    y = Write(Const(_text(y.value.value)))
                    if not y.value.value:
                        continue
                    if out and isinstance(out[-1], Write) and isinstance(out[-1].value, Const):
                        y = Write(Const(out.pop().value.value + y.value.value))
                out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if node.op in ("and", "or"):
            if isinstance(args[0], Const):
                return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        elif all(isinstance(a, Const) for a in args):
            return Const((FILTERS[node.op[1:]] if node.op[0] == "|" else _OPS[node.op])(*[a.value for a in args]))
        return Op(node.op, args)
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    if isinstance(node, Write):
        return Write(fold(node.value))
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.value))
    if isinstance(node, Loop):
        return Loop(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, Branch):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.yes if test.value else node.no)
        return Branch(test, fold(node.yes), fold(node.no))
    return node


# ---- closures

def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Item):
        of, key = _value(node.of), _value(node.key)

        def item(env):
            v = of(env)
            return v.get(key(env)) if isinstance(v, dict) else None

        return item
    args = [_value(a) for a in node.args]
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    f = FILTERS[node.op[1:]] if node.op[0] == "|" else _OPS[node.op]
    if len(args) == 1:
        return lambda env, a=args[0]: f(a(env))
    return lambda env, a=args[0], b=args[1]: f(a(env), b(env))


def _render(nodes: tuple, marked: bool) -> Callable[[dict], Iterator[tuple[bool, str]]]:
    steps: list[Callable] = []
    for node in nodes:
        if isinstance(node, Write):

            def write(env, v=_value(node.value)):
                yield marked, _text(v(env))

            steps.append(write)
        elif isinstance(node, Assign):

            def assign(env, n=node.name, v=_value(node.value)):
                env[n] = v(env)
                return ()

            steps.append(assign)
        elif isinstance(node, Generation):
            steps.append(_render(node.body, True))
        elif isinstance(node, Branch):

            def branch(env, t=_value(node.test), yes=_render(node.yes, marked), no=_render(node.no, marked)):
                return yes(env) if t(env) else no(env)

            steps.append(branch)
        else:

            def loop(env, n=node.name, over=_value(node.over), body=_render(node.body, marked)):
                values = over(env)
                if isinstance(values, (str, dict)) or not isinstance(values, Iterable):
                    raise TemplateError(f"{n} needs a list")
                before = env.get(n)
                for v in values:
                    env[n] = v
                    yield from body(env)
                env[n] = before

            steps.append(loop)

    def run(env):
        for step in steps:
            yield from step(env)

    return run


def compile_template(template: str) -> Callable[[dict], Iterator[tuple[bool, str]]]:
    """A function of variables that yields pieces of the output as (is generation, text).

    Pieces come as the list that a loop runs over is read, so a conversation of any
    length needs the memory of one turn.
    """
    body = _render(fold(parse(template)), False)
    return lambda variables: body(dict(variables))


#: Turns open with their role and close with a mark; assistants' texts are what is generated.
CHAT = (
    "{% for m in messages %}{{ '### ' + (m.role | escape_line) }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '</turn>\\n' }}{% endfor %}"
)

#: A formatted conversation comes in rows of about this many characters.
PIECE_CHARS = 1 << 20
_END = re.compile(r"\\.|</turn>\n", re.S)


def parse_turn(turn: str) -> tuple[str, str]:
    """Role and text of one turn of ``CHAT``."""
    head, _, rest = turn.partition("\n")
    while (len(head) - len(head.rstrip("\\"))) & 1:  # an escaped line end belongs to the role
        more, _, rest = rest.partition("\n")
        head += "\n" + more
    if not head.startswith("### ") or not rest.endswith("</turn>\n"):
        raise TemplateError(f"not a turn: {turn[:40]!r}")
    return unescape(head[4:]), unescape(rest[:-8])


def turns_of(pieces: Iterable[str]) -> Iterator[tuple[str, str]]:
    """Roles and texts of a conversation formatted by ``CHAT``, read piece by piece."""
    held = ""
    for piece in pieces:
        held, start = held + piece, 0
        for m in _END.finditer(held):
            if m[0][0] != "\\":
                yield parse_turn(held[start : m.end()])
                start = m.end()
        held = held[start:]
    if held:
        raise TemplateError(f"not a turn: {held[:40]!r}")


def _rows(batches, *columns: int):
    for batch in batches:
        yield from zip(*[batch.column(i).to_pylist() for i in columns], strict=True)


def _flush(out: dict, schema: pa.Schema):
    batch = pa.RecordBatch.from_pydict(out, schema=schema)
    for v in out.values():
        v.clear()
    return batch


def format_conversations(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: str = CHAT, piece_chars: int = PIECE_CHARS
) -> DataFrame:
    """Conversations written by ``template`` with ``messages`` of ``role`` and ``text``.

    A row per conversation, or several where it is longer than about ``piece_chars``:
    conversation, ``piece`` from 0, ``formatted`` and ``generated``, the spans of generated
    characters within the piece (code points, end exclusive). Turns go by ``turn``, ties by
    role and text, nulls first; null roles and texts are empty; a null conversation is one
    conversation; repeated rows are turns of their own; other columns are ignored. One
    shuffle by conversation and a sort; turns stream through the template, so that a
    conversation needs the memory of its longest turn.
    """
    compile_template(template)
    kind = dict(df.dtypes)[conversation]
    rows = df.select(
        F.col(conversation).alias("c"),
        F.col(turn).alias("t"),
        F.coalesce(F.col(role), F.lit("")).alias("r"),
        F.coalesce(F.col(text), F.lit("")).alias("x"),
    )

    def run(batches):
        render, schema = compile_template(template), None
        out = {"c": [], "piece": [], "formatted": [], "generated": []}
        held = 0
        batches = iter(batches)
        for first in batches:
            schema = pa.schema([("c", first.schema.types[0]), ("piece", pa.int64()), ("formatted", pa.string()), ("generated", pa.list_(pa.list_(pa.int64())))])
            rows = _rows(itertools.chain([first], batches), 0, 2, 3)
            for c, turns in itertools.groupby(rows, key=lambda row: row[0]):
                texts, spans, at, piece = [], [], 0, 0
                for marked, part in itertools.chain(render({"messages": ({"role": r, "text": x} for _, r, x in turns)}), [(False, None)]):
                    if at >= piece_chars or part is None and (at or not piece):
                        for k, v in zip(out, (c, piece, "".join(texts), spans), strict=True):
                            out[k].append(v)
                        held += at + 64
                        texts, spans, at, piece = [], [], 0, piece + 1
                        if held >= piece_chars:
                            yield _flush(out, schema)
                            held = 0
                    if part:
                        if marked:
                            spans.append([at, at + len(part)])
                        at += len(part)
                        texts.append(part)
            if out["c"]:
                yield _flush(out, schema)

    done = rows.repartition("c").sortWithinPartitions("c", "t", "r", "x")
    out = done.mapInArrow(run, f"c {kind}, piece long, formatted string, generated array<array<long>>")
    return out.withColumnRenamed("c", conversation)


def chat_digests(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """What the output of ``format_conversations`` with ``CHAT`` says when it is read back, a row per conversation.

    Columns: conversation, n_turns, turns_sha256 (role, line end, text, line end of each
    turn), loss_chars and loss_sha256 (texts under the generated spans without escapes),
    formatted_chars. Takes the rows in the order and the partitions they come in.
    """
    kind = dict(formatted.dtypes)[conversation]

    def run(batches):
        batches = iter(batches)
        for first in batches:
            schema = pa.schema(
                [("c", first.schema.types[0]), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
            )
            out = {n: [] for n in schema.names}
            rows = _rows(itertools.chain([first], batches), 0, 1, 2, 3)
            for c, pieces in itertools.groupby(rows, key=lambda row: row[0]):
                said, lost = hashlib.sha256(), hashlib.sha256()
                sizes = [0, 0, 0]  # turns, characters under the mask, characters

                def read(pieces=pieces, sizes=sizes, lost=lost):
                    for _, _, text, spans in pieces:
                        sizes[2] += len(text)
                        for start, end in spans:
                            own = unescape(text[start:end])
                            sizes[1] += len(own)
                            lost.update(own.encode("utf-8", "surrogatepass"))
                        yield text

                for role, text in turns_of(read()):
                    sizes[0] += 1
                    said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for k, v in zip(out, (c, sizes[0], said.hexdigest(), sizes[1], lost.hexdigest(), sizes[2]), strict=True):
                    out[k].append(v)
                if len(out["c"]) >= 10_000:
                    yield _flush(out, schema)
            yield _flush(out, schema)

    out = formatted.select(F.col(conversation).alias("c"), "piece", "formatted", "generated").mapInArrow(
        run, f"c {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return out.withColumnRenamed("c", conversation)
