"""Chat formatting by a small template compiler.

A template is parsed into a syntax tree, constants are folded, and the tree
becomes nested Python closures; no Python source is made or evaluated. The
language is a sandbox: values are strings, numbers, booleans, none, lists and
maps; `.name` and `['name']` look up map entries only; the filters are fixed.

    {{ expression }}   {# comment #}   {%- trims white space -%}
    {% for x in list %} ... {% endfor %}        loop.first, loop.last, loop.index
    {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}    marks what a model is trained on

Expressions: or, and, not, == != < <= > >= in, + ~ (text), literals, names,
look-ups, filters (escape, trim, upper, lower, length, default(x)).

A filter, operator or `for` that a value's kind doesn't allow is a TemplateError,
at compile time where only constants are involved.

`escape` makes text safe to stand between control strings: a backslash is
doubled, and one is put after the first character of every control string.
`unescape` takes that back exactly.

Defined cases: null text and null role are empty; rows of a conversation are
ordered by turn, then role, then text, so ties and repeated rows have one order;
a null conv_id is a conversation of its own; a conversation must fit into a
task's memory, as its formatted text is one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import small_batches

#: Strings that chat models read as control.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
DEFAULT = (
    "{% for m in messages %}<|im_start|>{{ m.role | escape }}<|im_sep|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|im_end|>\n{% endfor %}"
)
TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.S)
_TO_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


class TemplateError(ValueError):
    pass


_FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x),
    "default": lambda x, y="": y if x is None else x,
}
_QUOTED = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
_SPLIT = re.compile(rf"(\{{\{{-?(?:{_QUOTED}|.)*?-?\}}\}}|\{{%-?(?:{_QUOTED}|.)*?-?%\}}|\{{#.*?#\}})", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>|.,()\[\]=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _text(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else ("true" if x else "false") if isinstance(x, bool) else str(x)


def _checked(f: Callable, what: str) -> Callable:
    """f, whose complaints about kinds of values are TemplateErrors."""

    def run(*values: Any) -> Any:
        try:
            return f(*values)
        except TypeError:
            raise TemplateError(f"{what} does not take {', '.join(type(v).__name__ for v in values)}") from None

    return run


FILTERS = {name: _checked(f, f"filter {name}") for name, f in _FILTERS.items()}


# Syntax tree: ("const", v), ("name", n), ("get", a, b), ("filter", name, a, args), ("not", a),
# ("op", symbol, a, b); statements ("out", e), ("for", n, e, body), ("if", [(e, body)...]),
# ("set", n, e), ("gen", body), each body a list.


class _Expression:
    LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "~"))

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append(m)
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        m = self.tokens[self.at] if self.at < len(self.tokens) else None
        return m and (m[3] or m[4])

    def take(self, *symbols: str) -> str | None:
        if (s := self.peek()) in symbols:
            self.at += 1
            return s
        return None

    def need(self, symbol: str) -> None:
        if not self.take(symbol):
            raise TemplateError(f"expected {symbol!r}")

    def end(self, tree: tuple) -> tuple:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][0]!r}")
        return tree

    def parse(self, level: int = 0) -> tuple:
        if level == len(self.LEVELS):
            return self.filtered()
        if level == 2 and self.take("not"):
            return ("not", self.parse(level))
        left = self.parse(level + 1)
        while symbol := self.take(*self.LEVELS[level]):
            left = ("op", symbol, left, self.parse(level + 1))
        return left

    def filtered(self) -> tuple:
        tree = self.looked_up()
        while self.take("|"):
            name, args = self.name(), []
            if self.take("("):
                while not self.take(")"):
                    args.append(self.parse())
                    self.take(",")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = ("filter", name, tree, args)
        return tree

    def name(self) -> str:
        m = self.tokens[self.at] if self.at < len(self.tokens) else None
        if not m or not m[3]:
            raise TemplateError("expected a name")
        self.at += 1
        return m[3]

    def looked_up(self) -> tuple:
        tree = self.atom()
        while True:
            if self.take("."):
                tree = ("get", tree, ("const", self.name()))
            elif self.take("["):
                tree = ("get", tree, self.parse())
                self.need("]")
            else:
                return tree

    def atom(self) -> tuple:
        if self.take("("):
            tree = self.parse()
            self.need(")")
            return tree
        m = self.tokens[self.at] if self.at < len(self.tokens) else None
        if m is None:
            raise TemplateError("an expression ends early")
        if m[1]:
            self.at += 1
            return ("const", int(m[1]))
        if m[2]:
            self.at += 1
            return ("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m[2][1:-1], flags=re.S))
        name = self.name()
        return ("const", {"true": True, "false": False, "none": None}[name.lower()]) if name.lower() in ("true", "false", "none") else ("name", name)


def parse(template: str) -> list:
    """The syntax tree of a template."""
    parts = _SPLIT.split(template)
    for i in range(1, len(parts), 2):
        if parts[i][2:3] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if parts[i][-3:-2] == "-":
            parts[i + 1] = parts[i + 1].lstrip()
    top: list = []
    stack: list[tuple[str, list]] = [("", top)]
    for i, part in enumerate(parts):
        body = stack[-1][1]
        if i % 2 == 0:
            if part:
                body.append(("out", ("const", part)))
        elif part.startswith("{{"):
            e = _Expression(part[2:-2].strip("-"))
            body.append(("out", e.end(e.parse())))
        elif part.startswith("{%"):
            word, _, rest = part[2:-2].strip("-").strip().partition(" ")
            e = _Expression(rest)
            if word == "for":
                name = e.name()
                e.need("in")
                inner: list = []
                body.append(("for", name, e.end(e.parse()), inner))
                stack.append(("for", inner))
            elif word in ("if", "elif", "else"):
                inner = []
                test = ("const", True) if word == "else" else e.end(e.parse())
                if word == "if":
                    body.append(("if", [(test, inner)]))
                elif stack[-1][0] != "if":
                    raise TemplateError(f"{word} without if")
                else:
                    stack.pop()
                    stack[-1][1][-1][1].append((test, inner))
                stack.append(("if", inner))
            elif word == "set":
                name = e.name()
                e.need("=")
                body.append(("set", name, e.end(e.parse())))
            elif word == "generation":
                inner = []
                body.append(("gen", inner))
                stack.append(("generation", inner))
            elif word in ("endfor", "endif", "endgeneration") and stack[-1][0] == word[3:]:
                stack.pop()
            else:
                raise TemplateError(f"unexpected {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return top


_OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "~": lambda a, b: _text(a) + _text(b), "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
}
OPERATORS = {symbol: _checked(f, symbol) for symbol, f in _OPERATORS.items()}


def _look_up(held: Any, k: Any) -> Any:
    """An entry of a map or list; none if there is no such entry."""
    if isinstance(held, dict):
        return held.get(k) if isinstance(k, (str, int)) else None
    return held[k] if isinstance(held, list) and isinstance(k, int) and -len(held) <= k < len(held) else None


def fold(e: tuple) -> tuple:
    """An expression with its constant parts worked out."""
    kind = e[0]
    if kind in ("const", "name"):
        return e
    if kind == "not":
        a = fold(e[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "get":
        a, key = fold(e[1]), fold(e[2])
        return ("const", _look_up(a[1], key[1])) if a[0] == key[0] == "const" else ("get", a, key)
    if kind == "filter":
        a, args = fold(e[2]), [fold(x) for x in e[3]]
        done = all(x[0] == "const" for x in (a, *args))
        return ("const", FILTERS[e[1]](a[1], *[x[1] for x in args])) if done else ("filter", e[1], a, args)
    a, b = fold(e[2]), fold(e[3])
    if e[1] in ("and", "or"):
        return (b if bool(a[1]) == (e[1] == "and") else a) if a[0] == "const" else ("op", e[1], a, b)
    return ("const", OPERATORS[e[1]](a[1], b[1])) if a[0] == b[0] == "const" else ("op", e[1], a, b)


def fold_body(body: list) -> list:
    """Statements with folded expressions: decided branches go, neighbouring constant text joins."""
    out: list = []

    def put(e: tuple) -> None:
        if e[0] == "const" and out and out[-1][0] == "out" and out[-1][1][0] == "const":
            out[-1] = ("out", ("const", _text(out[-1][1][1]) + _text(e[1])))
        else:
            out.append(("out", e))

    for s in body:
        if s[0] == "out":
            put(fold(s[1]))
        elif s[0] == "if":
            branches = []
            for test, inner in s[1]:
                test = fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                branches.append((test, fold_body(inner)))
                if test[0] == "const":
                    break
            if branches and branches[0][0][0] == "const":
                for inner in branches[0][1]:
                    put(inner[1]) if inner[0] == "out" else out.append(inner)
            elif branches:
                out.append(("if", branches))
        elif s[0] == "for":
            items = fold(s[2])
            if items[0] == "const" and items[1]:  # no constant is a list
                raise TemplateError(f"for does not take {type(items[1]).__name__}")
            out.append(("for", s[1], items, fold_body(s[3])))
        elif s[0] == "set":
            out.append(("set", s[1], fold(s[2])))
        else:
            out.append(("gen", fold_body(s[1])))
    return out


def _value(e: tuple) -> Callable[[dict], Any]:
    """The closure of an expression."""
    kind = e[0]
    if kind == "const":
        return lambda env, v=e[1]: v
    if kind == "name":
        return lambda env, n=e[1]: env.get(n)
    if kind == "not":
        a = _value(e[1])
        return lambda env: not a(env)
    if kind == "get":
        a, key = _value(e[1]), _value(e[2])
        return lambda env: _look_up(a(env), key(env))
    if kind == "filter":
        f, a, args = FILTERS[e[1]], _value(e[2]), [_value(x) for x in e[3]]
        return lambda env: f(a(env), *[x(env) for x in args])
    a, b = _value(e[2]), _value(e[3])
    if e[1] == "and":
        return lambda env: a(env) and b(env)
    if e[1] == "or":
        return lambda env: a(env) or b(env)
    op = OPERATORS[e[1]]
    return lambda env: op(a(env), b(env))


def _body(body: list) -> Callable[[dict, "_Out", list], None]:
    """The closure of statements: writes text, and notes the ends of generation spans."""
    steps = [_statement(s) for s in body]

    def run(env: dict, write: "_Out", spans: list) -> None:
        for step in steps:
            step(env, write, spans)

    return run


def _statement(s: tuple) -> Callable[[dict, "_Out", list], None]:
    kind = s[0]
    if kind == "out":
        if s[1][0] == "const":
            return lambda env, write, spans, t=_text(s[1][1]): write(t)
        value = _value(s[1])
        return lambda env, write, spans: write(_text(value(env)))
    if kind == "set":
        name, value = s[1], _value(s[2])
        return lambda env, write, spans: env.__setitem__(name, value(env))
    if kind == "gen":
        inner = _body(s[1])

        def marked(env: dict, write: "_Out", spans: list) -> None:
            begin = write.length()
            inner(env, write, spans)
            spans.append((begin, write.length()))

        return marked
    if kind == "if":
        branches = [(_value(t), _body(b)) for t, b in s[1]]

        def choose(env: dict, write: "_Out", spans: list) -> None:
            for test, inner in branches:
                if test(env):
                    inner(env, write, spans)
                    return

        return choose
    name, items, inner = s[1], _value(s[2]), _body(s[3])

    def loop(env: dict, write: "_Out", spans: list) -> None:
        held = items(env) or []
        if not isinstance(held, list):
            raise TemplateError(f"for does not take {type(held).__name__}")
        before = {k: env.get(k) for k in (name, "loop")}
        for i, x in enumerate(held):
            env |= {name: x, "loop": {"first": i == 0, "last": i == len(held) - 1, "index": i + 1}}
            inner(env, write, spans)
        env |= before

    return loop


class _Out:
    def __init__(self):
        self.parts, self.size = [], 0

    def __call__(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def length(self) -> int:
        return self.size


def compile_template(template: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of keyword values: the text, and the spans of code points under generation markers."""
    run = _body(fold_body(parse(template)))

    def render(**values: Any) -> tuple[str, list[tuple[int, int]]]:
        out, spans = _Out(), []
        run(dict(values), out, spans)
        return "".join(out.parts), spans

    return render


def format_conversations(rows: DataFrame, template: str = DEFAULT) -> DataFrame:
    """conv_id, formatted, spans (array of start, stop) for each conversation of conv_id, turn, role, text."""
    compile_template(template)  # an error shows here, not in a task
    small_batches(rows.sparkSession)
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        ready: list[tuple] = []
        current, messages = None, []

        def done() -> None:
            text, spans = render(messages=messages)
            ready.append((current, text, [{"start": a, "stop": b} for a, b in spans]))

        def batch_of() -> pa.RecordBatch:
            ids, texts, spans = zip(*ready, strict=True)
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, span)], ["conv_id", "formatted", "spans"])

        for batch in batches:
            for conv_id, _, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if messages and conv_id != current:
                    done()
                    messages = []
                    if len(ready) >= 500:
                        yield batch_of()
                current = conv_id
                messages.append({"role": role, "text": text})
        if messages:
            done()
        if ready:
            yield batch_of()

    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, "conv_id long, formatted string, spans array<struct<start: long, stop: long>>")


def read_back(formatted: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], str]:
    """The turns (role, text) of a text of the default template, and the unescaped text under the loss mask."""
    turns, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"text between turns at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"text after the last turn at {at}")
    return turns, "".join(unescape(formatted[a:b]) for a, b in spans)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, text, spans in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "formatted", "spans")], strict=True):
                turns, loss = read_back(text, [(s["start"], s["stop"]) for s in spans])
                all_turns = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((conv_id, len(turns), all_turns, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
