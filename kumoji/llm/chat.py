"""Chat formatting with a template compiler.

A small sandboxed template language: text, {{ expressions }}, {% for x in xs %}, {% if %} / {% elif %} / {% else %},
{% set x = ... %} and {% generation %} ... {% endgeneration %}, which marks what a model is trained on. Expressions are
Python's syntax limited to literals, names, attributes and items of data, arithmetic, comparisons, and / or / not,
conditional expressions and calls of the given filters (x | trim). There is no access to Python objects: attributes
are keys of dicts. The parser makes a syntax tree, constant parts are folded and neighbouring text is merged, and each
node becomes a Python closure that yields (text, inside generation) pieces, so a conversation of any length is rendered
as a stream, a turn at a time.

Conversations are rendered from rows (conversation, turn, role, text): sorted within partitions by turn, then role and
text where turns tie, and streamed; no task holds a whole conversation.

Nulls and odd rows: a null text or role is an empty one; a null turn sorts first; rows without a conversation form one
conversation of their own; repeated rows are turns of their own; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import ast
import hashlib
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Piece = tuple[str, bool]
Closure = Callable[[dict, bool], Iterator[Piece]]

# ---- Syntax tree -----------------------------------------------------------------------------------------------------

TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)


class TemplateError(ValueError):
    pass


def parsed(source: str) -> list:
    """The tree: ("text", s), ("put", expr), ("set", name, expr), ("for", name, expr, body), ("if", [(expr, body)...]), ("mark", body)."""
    root: list = []
    stack: list[tuple[str, list, list]] = [("", root, root)]  # kind, node, the body now being filled
    at = 0
    for tag in chain(TAG.finditer(source), [None]):
        body = stack[-1][2]
        plain = source[at : tag.start() if tag else len(source)]
        if plain:
            body.append(("text", plain))
        if tag is None:
            break
        at = tag.end()
        if tag[1] is not None:
            body.append(("put", expression(tag[1])))
            continue
        word, _, rest = tag[2].strip().partition(" ")
        if word == "for":
            if not (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
                raise TemplateError(f"for: {rest}")
            node = ("for", m[1], expression(m[2]), [])
            body.append(node)
            stack.append(("for", node, node[3]))
        elif word == "if":
            node = ("if", [(expression(rest), [])])
            body.append(node)
            stack.append(("if", node, node[1][0][1]))
        elif word in ("elif", "else") and stack[-1][0] == "if":
            branch = (expression(rest) if word == "elif" else ast.Constant(True), [])
            stack[-1][1][1].append(branch)
            stack[-1] = ("if", stack[-1][1], branch[1])
        elif word == "set":
            if not (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(.+)", rest, re.S)):
                raise TemplateError(f"set: {rest}")
            body.append(("set", m[1], expression(m[2])))
        elif word == "generation":
            node = ("mark", [])
            body.append(node)
            stack.append(("generation", node, node[1]))
        elif word in ("endfor", "endif", "endgeneration") and stack[-1][0] == word[3:]:
            stack.pop()
        else:
            raise TemplateError(f"unexpected {tag[0]}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return root


ALLOWED = (
    ast.Constant, ast.Name, ast.Attribute, ast.Subscript, ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.Compare, ast.IfExp, ast.List, ast.Tuple, ast.Call, ast.Load,
    ast.Add, ast.Sub, ast.Mult, ast.Mod, ast.FloorDiv, ast.Not, ast.USub, ast.And, ast.Or, ast.Eq, ast.NotEq, ast.Lt, ast.LtE, ast.Gt, ast.GtE, ast.In, ast.NotIn,
)


def expression(source: str) -> ast.expr:
    """A checked expression; `x | f` is the call f(x)."""

    class Filters(ast.NodeTransformer):
        def visit_BinOp(self, node: ast.BinOp) -> ast.expr:
            node = self.generic_visit(node)
            if not isinstance(node.op, ast.BitOr):
                return node
            if isinstance(node.right, ast.Call):
                return ast.Call(node.right.func, [node.left, *node.right.args], [])
            return ast.Call(node.right, [node.left], [])

    try:
        tree = Filters().visit(ast.parse(source.strip(), mode="eval").body)
    except SyntaxError as e:
        raise TemplateError(f"{source.strip()}: {e.msg}") from None
    for node in ast.walk(tree):
        if not isinstance(node, ALLOWED) or isinstance(node, ast.Call) and (not isinstance(node.func, ast.Name) or node.keywords):
            raise TemplateError(f"{source.strip()}: {type(node).__name__} is not allowed")
    return tree


# ---- Compilation -----------------------------------------------------------------------------------------------------

#: Characters or items that a repetition may make at most.
LONGEST = 1 << 20


def _times(a, b):
    for many, n in ((a, b), (b, a)):
        if isinstance(many, (str, list)) and isinstance(n, int) and len(many) * n > LONGEST:
            raise TemplateError(f"a repetition of over {LONGEST}")
    return a * b


BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: _times, ast.Mod: operator.mod, ast.FloorDiv: operator.floordiv}
COMPARE = {
    ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge,
    ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b,
}
FILTERS: dict[str, Callable] = {"trim": lambda s: s.strip(), "upper": lambda s: s.upper(), "lower": lambda s: s.lower(), "length": len, "string": str}


class Compiler:
    def __init__(self, filters: dict[str, Callable]):
        self.filters = FILTERS | filters

    def value(self, node: ast.expr) -> tuple[bool, Callable[[dict], object]]:
        """(constant, closure)."""
        if isinstance(node, ast.Constant):
            v = node.value
            return True, lambda env: v
        if isinstance(node, ast.Name):
            name = node.id
            return False, lambda env: env.get(name, "")
        if isinstance(node, ast.Call):
            name = node.func.id
            if name not in self.filters:
                raise TemplateError(f"no filter {name}")
            function, parts = self.filters[name], [self.value(a) for a in node.args]
            return self.folded(all(c for c, _ in parts), lambda env: function(*(f(env) for _, f in parts)))
        if isinstance(node, (ast.Attribute, ast.Subscript)):
            of, key = self.value(node.value), (True, lambda env: node.attr) if isinstance(node, ast.Attribute) else self.value(node.slice)

            def item(env: dict):
                base, k = of[1](env), key[1](env)
                if isinstance(base, dict):
                    return base.get(k, "")
                if isinstance(base, (list, tuple, str)) and isinstance(k, int):
                    return base[k]
                raise TemplateError(f"no item {k!r}")

            return self.folded(of[0] and key[0], item)
        if isinstance(node, ast.BinOp):
            (a, f), (b, g), op = self.value(node.left), self.value(node.right), BINARY[type(node.op)]
            return self.folded(a and b, lambda env: op(f(env), g(env)))
        if isinstance(node, ast.UnaryOp):
            (a, f), op = self.value(node.operand), operator.not_ if isinstance(node.op, ast.Not) else operator.neg
            return self.folded(a, lambda env: op(f(env)))
        if isinstance(node, ast.BoolOp):
            parts, stop = [self.value(v) for v in node.values], isinstance(node.op, ast.Or)

            def chained(env: dict):
                for _, f in parts:
                    if bool(v := f(env)) == stop:
                        break
                return v

            return self.folded(all(c for c, _ in parts), chained)
        if isinstance(node, ast.Compare):
            parts, ops = [self.value(v) for v in (node.left, *node.comparators)], [COMPARE[type(o)] for o in node.ops]

            def compared(env: dict) -> bool:
                values = [f(env) for _, f in parts]
                return all(op(a, b) for op, a, b in zip(ops, values[:-1], values[1:], strict=True))

            return self.folded(all(c for c, _ in parts), compared)
        if isinstance(node, ast.IfExp):
            (t, test), (a, f), (b, g) = self.value(node.test), self.value(node.body), self.value(node.orelse)
            return self.folded(t and a and b, lambda env: f(env) if test(env) else g(env))
        parts = [self.value(v) for v in node.elts]
        return self.folded(all(c for c, _ in parts), lambda env: [f(env) for _, f in parts])

    @staticmethod
    def folded(constant: bool, closure: Callable[[dict], object]) -> tuple[bool, Callable[[dict], object]]:
        if not constant:
            return False, closure
        try:
            v = closure({})
        except (ArithmeticError, TypeError, ValueError, LookupError):  # left as it is: it may be in a branch that never runs
            return False, closure
        return True, lambda env: v

    def fold(self, nodes: list) -> list:
        """Constant puts become text, decided branches their bodies, and neighbouring texts one."""
        out: list = []
        for node in nodes:
            if node[0] == "put" and (done := self.value(node[1]))[0]:
                node = ("text", str(done[1]({})))
            new = [node]
            if node[0] == "for":
                new = [(*node[:3], self.fold(node[3]))]
            elif node[0] == "mark":
                new = [("mark", self.fold(node[1]))]
            elif node[0] == "if":
                branches = []
                for test, body in node[1]:
                    constant, f = self.value(test)
                    if constant and not f({}):
                        continue
                    branches.append((test, self.fold(body)))
                    if constant:
                        break
                decided = not branches or self.value(branches[0][0])[0]
                new = (branches[0][1] if branches else []) if decided else [("if", branches)]
            for n in new:
                if n[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + n[1])
                elif n != ("text", ""):
                    out.append(n)
        return out

    def body(self, nodes: list) -> Closure:
        parts = [self.node(n) for n in nodes]

        def run(env: dict, marked: bool) -> Iterator[Piece]:
            for part in parts:
                yield from part(env, marked)

        return parts[0] if len(parts) == 1 else run

    def node(self, node: tuple) -> Closure:
        if node[0] == "text":
            text = node[1]

            def run(env, marked):
                yield text, marked
        elif node[0] == "put":
            f = self.value(node[1])[1]

            def run(env, marked):
                yield str(f(env)), marked
        elif node[0] == "set":
            name, f = node[1], self.value(node[2])[1]

            def run(env, marked):
                env[name] = f(env)
                return iter(())
        elif node[0] == "mark":
            inner = self.body(node[1])

            def run(env, marked):
                return inner(env, True)
        elif node[0] == "if":
            branches = [(self.value(t)[1], self.body(b)) for t, b in node[1]]

            def run(env, marked):
                for test, inner in branches:
                    if test(env):
                        return inner(env, marked)
                return iter(())
        else:
            name, xs, inner = node[1], self.value(node[2])[1], self.body(node[3])

            def run(env, marked):
                items = iter(xs(env))  # a stream will do; one item ahead tells the last
                item = next(items, run)
                k = 0
                while item is not run:
                    ahead = next(items, run)
                    env |= {name: item, "loop": {"index0": k, "index": k + 1, "first": k == 0, "last": ahead is run}}
                    yield from inner(env, marked)
                    item, k = ahead, k + 1

        return run


def compiled(source: str, filters: dict[str, Callable] | None = None) -> Callable[[dict], Iterator[Piece]]:
    """A function of a context that yields pieces (text, inside generation)."""
    compiler = Compiler(filters or {})
    run = compiler.body(compiler.fold(parsed(source)))
    return lambda context: run(dict(context), False)


# ---- The turn format -------------------------------------------------------------------------------------------------

#: The format's own marks are made of characters that an escaped text doesn't have.
TURNS = "{% for message in messages %}### {{ message.role | escape }}: {% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}{% else %}{{ message.text | escape }}{% endif %}</turn>\n{% endfor %}"
CONTROL = re.compile(r"[\\#<:]")
CODES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
NAMES = {"\\": "\\", "h": "#", "l": "<", "c": ":"}


def escape(text: str) -> str:
    """Reversible; the result holds none of the format's marks."""
    return CONTROL.sub(lambda m: CODES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: NAMES[m[1]], text, flags=re.S)


HEAD = re.compile(r"### ([^:]*): ")


class Reader:
    """Reads the formatted stream back: turns, and what the loss mask covers."""

    def __init__(self):
        self.held: list[str] = []
        self.chars = self.turns = self.loss_chars = 0
        self.digest, self.loss = hashlib.sha256(), hashlib.sha256()
        self.masked: list[str] = []

    def feed(self, text: str, marked: bool) -> None:
        self.chars += len(text)
        self.held.append(text)
        if marked:
            self.masked.append(text)
        if text.endswith("</turn>\n"):
            self.turn("".join(self.held))
            self.held = []

    def turn(self, formatted: str) -> None:
        head = HEAD.match(formatted)
        role, text = unescape(head[1]), unescape(formatted[head.end() : -len("</turn>\n")])
        self.turns += 1
        self.digest.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if self.masked:
            covered = unescape("".join(self.masked))
            self.loss_chars += len(covered)
            self.loss.update(covered.encode("utf-8", "surrogatepass"))
            self.masked = []


# ---- Operators -------------------------------------------------------------------------------------------------------


def _streamed(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, per_conversation: Callable[[Iterable[dict]], tuple], names: list[str], kinds: list[pa.DataType], schema: str) -> DataFrame:
    own = rows.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = ((c, {"role": r, "text": t}) for b in batches for c, r, t in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True))
        ahead = next(turns, None)
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), *kinds], strict=True)], ["conv_id", *names])

        while ahead is not None:
            conv = ahead[0]

            def messages() -> Iterator[dict]:
                nonlocal ahead
                while ahead is not None and ahead[0] == conv:  # noqa: B023
                    message = ahead[1]
                    ahead = next(turns, None)
                    yield message

            stream = messages()
            done = per_conversation(stream)
            for _ in stream:  # a template need not use them all
                pass
            out.append((conv, *done))
            size += sum(len(x) for x in done if isinstance(x, (str, list)))
            if len(out) >= 1000 or size > 8 << 20:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    return dealt.mapInArrow(run, f"conv_id bigint, {schema}")


def formatted(rows: DataFrame, template: str = TURNS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans): the rendered conversation, and the generation marks as (start, end) in characters."""

    state: dict[str, Callable] = {}

    def one(messages: Iterable[dict]) -> tuple:
        if not state:
            state["render"] = compiled(template, {"escape": escape})
        parts, spans, at = [], [], 0
        for text, marked in state["render"]({"messages": messages}):
            if marked and text:
                if spans and spans[-1]["end"] == at:
                    spans[-1]["end"] = at + len(text)
                else:
                    spans.append({"start": at, "end": at + len(text)})
            at += len(text)
            parts.append(text)
        return "".join(parts), spans

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return _streamed(rows, conv_col, turn_col, role_col, text_col, one, ["formatted", "loss_spans"], [pa.string(), span], "formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def digests(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Read back from the formatted stream: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    state: dict[str, Callable] = {}

    def one(messages: Iterable[dict]) -> tuple:
        if not state:
            state["render"] = compiled(TURNS, {"escape": escape})
        reader = Reader()
        for text, marked in state["render"]({"messages": messages}):
            reader.feed(text, marked)
        return reader.turns, reader.digest.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars

    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return _streamed(rows, conv_col, turn_col, role_col, text_col, one, names, kinds, "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
