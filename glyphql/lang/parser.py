"""Recursive-descent parser with operator precedence.

Three symbols depend on their place. ``+`` opens a clause before a brace, lists tables inside brackets, is AND between
complete predicates inside a filter block, and adds elsewhere. ``*N`` with a digit is a limit, but for ``*3`` (select) and
``*4`` with assignments (update), unless ``limit_digits`` makes every digit a limit. ``<>`` twice is BETWEEN, once not-equal.
"""

from __future__ import annotations

import re
from dataclasses import replace

from .ast import (
    Between, Binary, Call, Case, Column, ColumnDef, Create, Delete, Drop, Expr, In, Index, Insert, Interval, IsNull, Item, Let, Literal, OrderItem,
    Parameter, Scalar, Select, Source, Star, Statement, Transaction, Unary, Update, Window,
)
from .lexer import SyntaxProblem, Token, tokens

JOINS = {"J": "inner", "L": "left", "R": "right", "F": "full", "C": "cross", "S": "self", "N": "natural", "U": "union"}
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX"}
LIMITS = {"ALL", "FIRST", "LAST", "RANDOM"}
VERBS = AGGREGATES | LIMITS | {"DISTINCT", "GROUP_COUNT", "ROW"}
COMPARISONS = {"=": "=", "==": "=", "!=": "<>", "<>": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">=", "~": "LIKE"}
WORD_COMPARISONS = {"IS", "IN", "LIKE", "BETWEEN", "NOT", "CONTAINS", "STARTSWITH", "ENDSWITH", "RECENT", "OLDER_THAN", "BETWEEN_DATES"}
STOP_WORDS = {"AS", "AND", "OR", "NOT", "UNION", "THEN", "WHEN", "ELSE", "END", "ASC", "DESC", "IN", "LIKE", "BETWEEN", "IS", "ON", "FROM"}
UNITS = {"d": "DAY", "h": "HOUR", "m": "MINUTE", "w": "WEEK", "s": "SECOND"}


def parse(text: str, limit_digits: bool = False) -> list[Statement]:
    """All statements of a text, separated by semicolons."""
    p = _Parser(text, limit_digits)
    out: list[Statement] = []
    while not p.at("end"):
        if p.take(";"):
            continue
        out.append(p.statement())
        if not p.at("end"):
            p.need(";")
    return out


def parse_one(text: str, limit_digits: bool = False) -> Statement:
    found = parse(text, limit_digits)
    if len(found) != 1:
        raise SyntaxProblem(f"expected one statement, found {len(found)}", text, 0)
    return found[0]


def parse_condition(text: str) -> Expr:
    p = _Parser(text, False)
    out = p.expression(block=True)
    if not p.at("end"):
        p.fail("unexpected text after the condition")
    return out


class _Parser:
    def __init__(self, text: str, limit_digits: bool):
        self.text, self.toks, self.k, self.limit_digits = text, tokens(text), 0, limit_digits

    # Tokens

    def peek(self, ahead: int = 0) -> Token:
        return self.toks[min(self.k + ahead, len(self.toks) - 1)]

    def at(self, *texts: str, ahead: int = 0) -> bool:
        """Whether the next token is one of these symbols, words (any case) or kinds of token."""
        t = self.peek(ahead)
        return (t.kind in ("symbol", "word") and t.text.upper() in texts) or (t.kind in texts and t.kind in ("end", "string", "number", "span", "word", "quoted"))

    def take(self, *texts: str) -> Token | None:
        if self.at(*texts):
            self.k += 1
            return self.toks[self.k - 1]
        return None

    def need(self, *texts: str) -> Token:
        return self.take(*texts) or self.fail(f"expected {' or '.join(texts)}, found {self.peek().text or 'the end'!r}")

    def fail(self, message: str):
        raise SyntaxProblem(message, self.text, self.peek().at)

    def name(self) -> str:
        t = self.take("word", "quoted")
        return t.text if t else self.fail(f"expected a name, found {self.peek().text or 'the end'!r}")

    # Statements

    def statement(self) -> Statement:
        if self.at("&") and self.at("word", ahead=1) and self.at("=", ahead=2):
            self.k += 1
            name = self.name()
            self.need("=")
            return Let(name, self.select())
        if self.at("$") and self.at("number", ahead=1):
            self.k += 1
            action = {"1": "begin", "2": "commit", "3": "rollback"}.get(self.need("number").text)
            return Transaction(action or self.fail("expected $1, $2 or $3"))
        if self.at("+") and self.at("V", ahead=1):
            return self.insert()
        if self.at("-") and self.at("D", ahead=1):
            self.k += 2
            table = self.bracketed_name()
            if self.take("::") and not self.at("+", "|", ">>", ";", "end"):
                self.fail("a delete has no columns")
            where = self.where_clauses()
            self.outputs()
            return Delete(table, where)
        if self.at("@"):
            return self.schema()
        if self.at("##", "#"):
            if not self.take("##"):
                self.k += 1
                self.need("number")
            self.need("[")
            names = [self.name()]
            while self.take(","):
                names.append(self.name())
            self.need("]")
            self.take("::")
            self.outputs()
            return Index(names[0], tuple(names[1:]))
        if self.at("*") and self.peek(1).text == "4" and not self.limit_digits and self._assigns():
            return self.update()
        return self.select()

    def _assigns(self) -> bool:
        """Whether ``*4[t]::name=`` follows."""
        return self.at("[", ahead=2) and self.at("]", ahead=4) and self.at("::", ahead=5) and self.at("word", "quoted", ahead=6) and self.at("=", ahead=7)

    def bracketed_name(self) -> str:
        self.need("[")
        name = self.name()
        self.need("]")
        return name

    def where_clauses(self) -> Expr | None:
        where = None
        while (self.at("+") and self.at("{", ahead=1)) or self.at("|"):
            part = self.filter_clause()
            where = part if where is None else Binary("AND", where, part)
        return where

    def filter_clause(self) -> Expr:
        if self.take("|"):
            return self.expression(block=False)
        self.need("+")
        self.need("{")
        out = self.expression(block=True)
        self.need("}")
        return out

    def outputs(self) -> tuple[str, ...]:
        out = []
        while self.take(">>"):
            word = self.name()
            if self.take("("):  # CACHE(1h)
                word += f"({self.peek().text})"
                self.k += 1
                self.need(")")
            out.append(word)
        return tuple(out)

    def raw_until(self, *stops: str) -> str:
        """The source text up to one of these symbols outside brackets."""
        start, depth = self.peek().at, 0
        while not self.at("end"):
            if not depth and self.at(*stops):
                break
            depth += self.at("(", "[", "{") - self.at(")", "]", "}")
            self.k += 1
        return self.text[start : self.peek().at].strip()

    def raw_value(self, text: str) -> object:
        """A value of an insert, where text needs no quotes."""
        t = text.strip()
        if t.upper() == "NULL" or not t:
            return None
        if t.lower() in ("true", "false"):
            return t.lower() == "true"
        if re.fullmatch(r"-?\d+", t):
            return int(t)
        if re.fullmatch(r"-?\d+\.\d+", t):
            return float(t)
        return t[1:-1].replace("''", "'") if len(t) > 1 and t[0] == t[-1] == "'" else t

    def insert(self) -> Insert:
        self.k += 2
        self.need("[")
        table, columns = self.name(), []
        if self.take("("):
            columns.append(self.name())
            while self.take(","):
                columns.append(self.name())
            self.need(")")
        self.need("]")
        self.need("::")
        rows: list[list[object]] = []
        while True:
            row = [self.raw_value(self.raw_until(",", ";", ">>"))]
            while self.take(","):
                row.append(self.raw_value(self.raw_until(",", ";", ">>")))
            rows.append(row)
            # A semicolon parts rows, unless it ends the statement: what follows then begins with a statement's symbol.
            if not self.at(";") or self.at("end", "*", "$", "+", "-", "=", "&", "@", "#", "##", ahead=1):
                break
            self.k += 1
        self.outputs()
        width = len(columns) or len(rows[0])
        if any(len(r) != width for r in rows):
            self.fail(f"every row needs {width} values")
        return Insert(table, tuple(columns), tuple(map(tuple, rows)))

    def update(self) -> Update:
        self.k += 2
        table = self.bracketed_name()
        self.need("::")
        changes = []
        while True:
            name = self.name()
            self.need("=")
            # A bare word is text, as in an insert; anything else is an expression.
            ends = self.at(",", "|", ">>", ";", "end", ahead=1) or (self.at("+", ahead=1) and self.at("{", ahead=2))
            bare = self.at("word") and ends and not self.at("TRUE", "FALSE", "NULL")
            if bare:
                changes.append((name, Literal(self.name())))
            else:
                changes.append((name, self.expression(block=False)))
            if not self.take(","):
                break
        where = self.where_clauses()
        self.outputs()
        return Update(table, tuple(changes), where)

    def schema(self) -> Create | Drop:
        self.need("@")
        if self.take("A"):
            table = self.bracketed_name()
            self.need("::")
            columns = [self.column_def()]
            while self.take(","):
                columns.append(self.column_def())
            self.outputs()
            return Create(table, tuple(columns))
        if self.peek().text == "3":
            self.k += 1
            table = self.bracketed_name()
            self.take("::")
            self.outputs()
            return Drop(table)
        self.fail("expected @A or @3")

    def column_def(self) -> ColumnDef:
        out = ColumnDef(self.name(), self.raw_until("!", ",", ">>", ";"))
        while self.take("!"):
            mark = self.need("number").text
            raw = None
            if self.take("("):
                raw = self.raw_until(")")
                self.need(")")
            match mark, raw:
                case "1", _:
                    out = replace(out, primary=True, required=True)
                case "2", str():
                    table, _, column = raw.partition(".")
                    out = replace(out, references=(table.strip(), column.strip()))
                case "3", _:
                    out = replace(out, unique=True)
                case "4", _:
                    out = replace(out, required=True)
                case "5", str():
                    out = replace(out, check=raw)
                case "6", str():
                    out = replace(out, default=raw)
                case _:
                    self.fail(f"unknown constraint !{mark}")
        return out

    # Queries

    def starts_select(self, ahead: int = 0) -> bool:
        if self.at("*", ahead=ahead):
            word = self.peek(ahead + 1)
            return word.text == "[" or (self.peek(ahead + 2).text == "[" and (word.kind == "number" or word.text.upper() in VERBS))
        return self.at("=", ahead=ahead) and self.peek(ahead + 1).text in JOINS and self.at("[", ahead=ahead + 2)

    def select(self) -> Select:
        out = self.simple_select()
        unions = []
        while self.take("UNION"):
            every = bool(self.take("ALL"))
            unions.append((every, self.simple_select()))
        if unions:
            # Order and limit after the last branch are those of the whole.
            every, last = unions[-1]
            unions[-1] = every, replace(last, order=(), limit=None, offset=None)
            out = replace(out, unions=tuple(unions), outputs=out.outputs or last.outputs, order=last.order, limit=last.limit, offset=last.offset)
        return out

    def simple_select(self) -> Select:
        verb, join, limit = "SELECT", "inner", None
        if self.take("*"):
            if t := self.take("number"):
                if t.text != "3" or self.limit_digits:
                    limit = int(t.text)
            elif self.at("word"):
                verb = self.name().upper()
                if verb not in VERBS:
                    self.fail(f"unknown verb *{verb}")
        elif self.at("=") and self.peek(1).text in JOINS:
            join = JOINS[self.peek(1).text]
            self.k += 2
        else:
            self.fail("a query begins with * or a join symbol")
        self.need("[")
        sources = [self.source()]
        while self.take("+", ","):
            sources.append(self.source())
        self.need("]")
        items: list[Item] = []
        distinct = False
        if self.take("::") and not self.at(">>", ";", "end", "|", ")", "}"):
            if self.at("DISTINCT") and self.at("(", ahead=1):
                self.k += 2
                distinct = True
                items += self.items()
                self.need(")")
                if self.take(","):
                    items += self.items()
            else:
                items = self.items()
        if verb in ("FIRST", "LAST", "RANDOM"):
            limit = 1
        fields: dict = {"limit": limit}
        while True:
            if (self.at("+") and self.at("{", ahead=1)) or self.at("|"):
                part = self.filter_clause()
                fields["where"] = Binary("AND", fields["where"], part) if fields.get("where") else part
            elif self.at("^") and self.at("{", ahead=1):
                self.k += 2
                group = [self.expression(block=False)]
                while self.take(","):
                    group.append(self.expression(block=False))
                self.need("}")
                fields["group"] = tuple(group)
            elif self.at("$") and self.at("{", ahead=1):
                self.k += 2
                fields["having"] = self.expression(block=True)
                self.need("}")
            elif self.at("~") and self.at("{", ahead=1):
                self.k += 2
                fields["order"] = self.order_items()
                self.need("}")
            elif self.at("ON") and self.at("{", ahead=1):
                self.k += 2
                fields["on"] = self.expression(block=True)
                self.need("}")
            elif self.take("["):
                fields["limit"] = int(self.need("number").text)
                if self.take(","):
                    fields["offset"] = int(self.need("number").text)
                self.need("]")
            else:
                break
        return Select(verb, join, tuple(sources), tuple(items), distinct, outputs=self.outputs(), **fields)

    def source(self) -> Source:
        if self.take("("):
            query = self.select()
            self.need(")")
            self.take("AS")
            alias = self.name()
            return Source(alias, alias, query=query)
        memory = bool(self.take("&"))
        name = self.name()
        while self.take("."):
            name += "." + self.name()
        self.take("AS")
        alias = self.name() if self.at("word", "quoted") else name
        return Source(name, alias, memory)

    def items(self) -> list[Item]:
        out = [self.item()]
        while self.take(","):
            out.append(self.item())
        return out

    def item(self) -> Item:
        if self.at("*") and not self.starts_window() and not self.starts_select():
            self.k += 1
            return Item(Star())
        value = self.expression(block=False)
        return Item(value, self.name() if self.take("AS") else None)

    def order_items(self) -> tuple[OrderItem, ...]:
        out = []
        while True:
            value = self.expression(block=False)
            descending = bool(self.take("DESC")) or (bool(self.take("ASC")) and False)
            out.append(OrderItem(value, descending))
            if not self.take(","):
                return tuple(out)

    # Expressions

    def expression(self, block: bool) -> Expr:
        """block: inside a filter block, where + between complete predicates is AND."""
        value = self.disjunction(block)
        if self.take("?"):
            whens = [(value, self.disjunction(False))]
            self.need(":")
            rest = self.expression(block=False)
            if isinstance(rest, Case) and rest.subject is None:
                return Case(None, (*whens, *rest.whens), rest.otherwise)
            return Case(None, tuple(whens), rest)
        return value

    def disjunction(self, block: bool) -> Expr:
        left = self.conjunction(block)
        while self.take("OR", "||"):
            left = Binary("OR", left, self.conjunction(block))
        return left

    def conjunction(self, block: bool) -> Expr:
        left = self.negation(block)
        while True:
            if self.take("AND", "&&") or (block and self._is_predicate(left) and self.at("+") and not self.at("{", ahead=1) and self.take("+")):
                left = Binary("AND", left, self.negation(block))
            else:
                return left

    @staticmethod
    def _is_predicate(e: Expr) -> bool:
        return isinstance(e, Between | In | IsNull) or (isinstance(e, Binary) and e.op in ("=", "<>", "<", "<=", ">", ">=", "LIKE", "AND", "OR")) or (
            isinstance(e, Unary) and e.op == "NOT") or (isinstance(e, Call) and e.name in ("CONTAINS", "STARTSWITH", "ENDSWITH", "RECENT", "OLDER_THAN", "SEARCH"))

    def negation(self, block: bool) -> Expr:
        if self.at("NOT") or (self.at("!") and not self.at("=", ahead=1)):
            self.k += 1
            return Unary("NOT", self.negation(block))
        return self.comparison(block)

    def comparison(self, block: bool) -> Expr:
        left = self.sum(block, after=False)
        t = self.peek()
        if t.kind == "symbol" and t.text in COMPARISONS and not (t.text == "~" and self.at("{", ahead=1)):
            self.k += 1
            right = self.sum(block, after=True)
            if t.text == "<>" and self.take("<>"):
                return Between(left, right, self.sum(block, after=True))
            return Binary(COMPARISONS[t.text], left, right)
        if self.at("@") and (self.at("[", ahead=1) or self.starts_select(1)):
            self.k += 1
            if self.starts_select():
                return In(left, self.select())
            self.need("[")
            options = self.arguments("]")
            return In(left, options)
        if not self.at(*WORD_COMPARISONS):
            return left
        negated = bool(self.take("NOT"))
        if self.take("IS"):
            negated = bool(self.take("NOT"))
            self.need("NULL")
            return IsNull(left, negated)
        if self.take("IN"):
            self.need("(")
            if self.starts_select():
                query = self.select()
                self.need(")")
                return In(left, query, negated)
            return In(left, self.arguments(")"), negated)
        if self.take("BETWEEN", "BETWEEN_DATES"):
            if self.take("("):
                low, high = self.arguments(")")
            else:
                low = self.sum(False, after=False)
                self.need("AND")
                high = self.sum(block, after=True)
            return Between(left, low, high, negated)
        if self.take("LIKE"):
            out: Expr = Binary("LIKE", left, self.sum(block, after=True))
            return Unary("NOT", out) if negated else out
        word = self.name().upper()
        self.need("(")
        out = Call(word, (left, *self.arguments(")")))
        return Unary("NOT", out) if negated else out

    def arguments(self, close: str) -> tuple[Expr, ...]:
        out: list[Expr] = []
        while not self.take(close):
            out.append(self.item().value)
            if not self.at(close):
                self.need(",")
        return tuple(out)

    def sum(self, block: bool, after: bool) -> Expr:
        """after: right of a comparison in a filter block, where a + that another predicate follows is AND."""
        left = self.product()
        while self.at("+", "-"):
            if self.at("+") and (self.at("{", ahead=1) or (block and after and self._predicate_follows())):
                break
            op = self.toks[self.k].text
            self.k += 1
            left = Binary(op, left, self.product())
        return left

    def _predicate_follows(self) -> bool:
        mark = self.k
        try:
            self.k += 1
            if self.at("NOT", "!"):
                return True
            e = self.sum(False, after=False)
            t = self.peek()
            return self._is_predicate(e) or (t.kind == "symbol" and t.text in COMPARISONS) or self.at("@", *WORD_COMPARISONS)
        except SyntaxProblem:
            return False
        finally:
            self.k = mark

    def product(self) -> Expr:
        left = self.unary()
        while self.at("*", "/", "%") and not (self.at("*") and self.at(",", ">>", ")", "}", "+", "end", ahead=1)):
            op = self.toks[self.k].text
            self.k += 1
            left = Binary(op, left, self.unary())
        return left

    def unary(self) -> Expr:
        if self.take("-"):
            return Unary("-", self.unary())
        value = self.primary()
        if self.at("+") and self.at("{", ahead=1) and self.at("ORDER", "PARTITION", "ROWS", ahead=2) and isinstance(value, Call):
            return self.window(value)
        return value

    def starts_window(self, ahead: int = 0) -> bool:
        return self.at("*", ahead=ahead) and self.at("word", ahead=ahead + 1) and (self.at("(", ahead=ahead + 2) or (self.at("+", ahead=ahead + 2) and self.at("{", ahead=ahead + 3)))

    def window(self, call: Call) -> Window:
        self.k += 2
        partition: list[Expr] = []
        order: tuple[OrderItem, ...] = ()
        frame = None
        if self.take("PARTITION"):
            self.need("BY")
            partition.append(self.expression(block=False))
            while self.take(","):
                partition.append(self.expression(block=False))
        if self.take("ORDER"):
            self.need("BY")
            order = self.order_items()
        if self.take("ROWS"):
            frame = "ROWS " + self.raw_until("}")
            if not re.fullmatch(r"(?i)ROWS (BETWEEN )?(UNBOUNDED|\d+|CURRENT) (PRECEDING|FOLLOWING|ROW)( AND (UNBOUNDED|\d+|CURRENT) (PRECEDING|FOLLOWING|ROW))?", " ".join(frame.split())):
                self.fail(f"unknown window frame {frame!r}")
        self.need("}")
        return Window(call, tuple(partition), order, frame)

    def primary(self) -> Expr:
        t = self.peek()
        if self.starts_window():
            self.k += 1
            name = self.name().upper()
            args: tuple[Expr, ...] = self.arguments(")") if self.take("(") else ()
            call = Call("ROW_NUMBER" if name == "ROW" else name, args)
            return self.window(call) if self.at("+") and self.at("{", ahead=1) else Window(call)
        if self.take("("):
            if self.starts_select():
                out: Expr = Scalar(self.select())
            else:
                out = self.expression(block=False)
            self.need(")")
            return out
        if self.take("{"):
            out = self.expression(block=False)
            self.need("}")
            return out
        if self.take("@"):
            return Parameter(self.name())
        if self.take("string"):
            return Literal(t.text)
        if self.take("number"):
            return Literal(int(t.text) if t.text.isdigit() else float(t.text))
        if self.take("span"):
            return Interval(Literal(int(t.text[:-1])), UNITS[t.text[-1]])
        if t.kind == "word":
            word = t.text.upper()
            if word in ("TRUE", "FALSE", "NULL"):
                self.k += 1
                return Literal({"TRUE": True, "FALSE": False, "NULL": None}[word])
            if word == "CASE":
                return self.case()
            if word == "INTERVAL":
                self.k += 1
                amount = self.primary()
                return Interval(amount, self.name().upper())
            if word == "CURRENT_DATE" and not self.at("(", ahead=1):
                self.k += 1
                return Call("CURRENT_DATE", ())
            if self.at("(", ahead=1):
                self.k += 2
                distinct = bool(self.take("DISTINCT"))
                return Call(word, self.arguments(")"), distinct)
            if word in STOP_WORDS:
                self.fail(f"unexpected {t.text}")
        if t.kind in ("word", "quoted"):
            parts = [self.name()]
            while self.at(".") and (self.at("word", "quoted", ahead=1) or self.at("*", ahead=1)):
                self.k += 1
                if self.take("*"):
                    return Star(parts[0])
                parts.append(self.name())
            return Column(tuple(parts), t.at)
        self.fail(f"unexpected {t.text or 'end'!r}")

    def case(self) -> Case:
        self.need("CASE")
        subject = None if self.at("WHEN") else self.expression(block=False)
        whens = []
        while self.take("WHEN"):
            condition = self.expression(block=False)
            self.need("THEN")
            whens.append((condition, self.expression(block=False)))
        otherwise = self.expression(block=False) if self.take("ELSE") else None
        self.need("END")
        return Case(subject, tuple(whens), otherwise)
