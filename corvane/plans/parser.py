"""Recursive-descent parser of the dialect. Everything up to the end of the text must belong to the statement."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import SqlSyntaxError
from ..functions.types import type_name
from . import ast as a

_TOKEN = re.compile(r"\s*(?:('(?:[^']|'')*')|(<=|>=|<>|!=|[(),*=<>;])|([^\s'(),*=<>!;]+))", re.S)
_INTEGER = re.compile(r"[+-]?\d+")
_FLOAT = re.compile(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?")
_NAME = re.compile(r"[A-Za-z_][\w$]*(\.[A-Za-z_][\w$]*)?")
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
RANKINGS = ("ROW_NUMBER", "RANK", "DENSE_RANK")
RESERVED = frozenset(
    "SELECT FROM WHERE GROUP BY HAVING ORDER LIMIT OFFSET JOIN INNER LEFT RIGHT ON UNION INTERSECT EXCEPT ALL AND OR NOT IN IS LIKE AS DISTINCT BETWEEN".split()
)


@dataclass(frozen=True)
class Token:
    text: str
    quoted: bool = False

    @property
    def key(self) -> str:
        return "" if self.quoted else self.text.upper()


def tokenize(sql: str) -> list[Token]:
    out, at, sql = [], 0, sql.rstrip()
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlSyntaxError(f"Unterminated string or unexpected character at {sql[at : at + 20]!r}")
        out.append(Token(m[1][1:-1].replace("''", "'"), True) if m[1] is not None else Token(m[2] or m[3]))
        at = m.end()
    return out


def literal(t: Token) -> a.Value:
    """A value: $n, quoted text, NULL, TRUE, FALSE, a number, else the bare word as text."""
    if t.quoted:
        return t.text
    if re.fullmatch(r"\$\d+", t.text):
        return a.Param(int(t.text[1:]))
    if t.key in ("NULL", "TRUE", "FALSE"):
        return {"NULL": a.Null(), "TRUE": True, "FALSE": False}[t.key]
    if _INTEGER.fullmatch(t.text):
        return int(t.text)
    if _FLOAT.fullmatch(t.text):
        return float(t.text)
    if t.text in ("(", ")", ",", "*", "=", "<", ">", "<=", ">=", "<>", "!=", ";"):
        raise SqlSyntaxError(f"Expected a value, found {t.text}")
    return t.text


class Parser:
    def __init__(self, sql: str):
        self.tokens = tokenize(sql)
        while self.tokens and self.tokens[-1] == Token(";"):
            self.tokens.pop()
        self.at = 0

    # Tokens.

    def peek(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.tokens[k].key if k < len(self.tokens) else ""

    def next(self, what: str = "more") -> Token:
        if self.at >= len(self.tokens):
            raise SqlSyntaxError(f"Expected {what}, found the end")
        self.at += 1
        return self.tokens[self.at - 1]

    def take(self, *words: str) -> bool:
        if all(self.peek(k) == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        for w in words:
            if not self.take(w):
                raise SqlSyntaxError(f"Expected {w}" + (f", found {self.tokens[self.at].text}" if self.at < len(self.tokens) else ""))

    def name(self, what: str = "a name") -> str:
        t = self.next(what)
        if t.quoted or not _NAME.fullmatch(t.text) or "." in t.text or t.key in RESERVED:
            raise SqlSyntaxError(f"Expected {what}, found {t.text}")
        return t.text

    def column(self, what: str = "a column") -> a.ColumnRef:
        t = self.next(what)
        if t.quoted or not _NAME.fullmatch(t.text) or t.key in RESERVED:
            raise SqlSyntaxError(f"Expected {what}, found {t.text}")
        table, _, name = t.text.rpartition(".")
        return a.ColumnRef(name, table or None)

    # Statements.

    def parse(self) -> a.Statement:
        if not self.tokens:
            raise SqlSyntaxError("Empty statement")
        out = self.statement()
        if self.at < len(self.tokens):
            raise SqlSyntaxError(f"Unexpected {self.tokens[self.at].text}")
        return out

    def statement(self) -> a.Statement:
        word = self.peek()
        if word == "SELECT":
            return self.query()
        if word == "EXPLAIN":
            self.at += 1
            analyze = self.take("ANALYZE")
            return a.Explain(self.statement(), analyze)
        made = {"CREATE": self.create, "DROP": self.drop, "SHOW": self.show, "INSERT": self.insert, "UPDATE": self.update, "DELETE": self.delete}.get(word)
        if made:
            return made()
        if word in ("BEGIN", "START", "COMMIT", "END", "ROLLBACK", "ABORT", "SET", "SAVEPOINT", "RELEASE"):
            return self.transaction()
        raise SqlSyntaxError(f"Unsupported: {self.next('a statement').text}")

    def transaction(self) -> a.Transaction:
        word = self.next().key
        if word == "SET":
            rest = tuple(t.text for t in self.tokens[self.at :])
            self.at = len(self.tokens)
            return a.Transaction("set", extra=rest)
        if word == "SAVEPOINT":
            return a.Transaction("savepoint", self.name("a savepoint"))
        if word == "RELEASE":
            self.take("SAVEPOINT")
            return a.Transaction("release", self.name("a savepoint"))
        if word == "START":
            self.expect("TRANSACTION")
        elif not self.take("WORK"):
            self.take("TRANSACTION")
        if word in ("BEGIN", "START"):
            rest = tuple(t.text for t in self.tokens[self.at :])
            self.at = len(self.tokens)
            return a.Transaction("begin", extra=rest)
        if word in ("ROLLBACK", "ABORT") and self.take("TO"):
            self.take("SAVEPOINT")
            return a.Transaction("rollback_to", self.name("a savepoint"))
        chain = False
        if self.take("AND"):
            chain = not self.take("NO")
            self.expect("CHAIN")
        return a.Transaction("commit" if word in ("COMMIT", "END") else "rollback", chain=chain)

    def create(self) -> a.CreateTable:
        self.expect("CREATE")
        if self.peek() != "TABLE":
            raise SqlSyntaxError(f"Unsupported: CREATE {self.peek()}")
        self.expect("TABLE")
        lenient = self.take("IF", "NOT", "EXISTS")
        table = self.name("a table name")
        self.expect("(")
        columns = []
        while True:
            column, kind = self.name("a column name"), self.next("a type").text
            type_name(kind)
            if self.take("("):  # a length has no effect
                while not self.take(")"):
                    self.next(")")
            flags: dict = {}
            while self.peek() not in (",", ")"):
                if self.take("PRIMARY", "KEY"):
                    flags["primary_key"] = True
                elif self.take("NOT", "NULL"):
                    flags["not_null"] = True
                elif self.take("DEFAULT"):
                    flags["default"] = literal(self.next("a value"))
                else:
                    raise SqlSyntaxError(f"Unexpected {self.next(')').text} in CREATE TABLE")
            columns.append(a.ColumnDef(column, type_name(kind), **flags))
            if self.take(")"):
                break
            self.expect(",")
        if len({c.name.lower() for c in columns}) < len(columns):
            raise SqlSyntaxError("a column is named twice")
        if sum(c.primary_key for c in columns) > 1:
            raise SqlSyntaxError("a table has one primary key column")
        return a.CreateTable(table, tuple(columns), lenient)

    def drop(self) -> a.DropTable:
        self.expect("DROP")
        if self.peek() != "TABLE":
            raise SqlSyntaxError(f"Unsupported: DROP {self.peek()}")
        self.expect("TABLE")
        lenient = self.take("IF", "EXISTS")
        return a.DropTable(self.name("a table name"), lenient)

    def show(self) -> a.ShowTables:
        self.at = len(self.tokens)
        return a.ShowTables()

    def values(self) -> tuple[a.Value, ...]:
        self.expect("(")
        out = [literal(self.next("a value"))]
        while self.take(","):
            out.append(literal(self.next("a value")))
        self.expect(")")
        return tuple(out)

    def insert(self) -> a.Insert:
        self.expect("INSERT", "INTO")
        table, columns = self.name("a table name"), ()
        if self.take("("):
            names = [self.name("a column name")]
            while self.take(","):
                names.append(self.name("a column name"))
            self.expect(")")
            columns = tuple(names)
        self.expect("VALUES")
        rows = [self.values()]
        while self.take(","):
            rows.append(self.values())
        return a.Insert(table, columns, tuple(rows))

    def update(self) -> a.Update:
        self.expect("UPDATE")
        table = self.name("a table name")
        self.expect("SET")
        sets = []
        while True:
            column = self.name("a column name")
            self.expect("=")
            sets.append((column, literal(self.next("a value"))))
            if not self.take(","):
                break
        return a.Update(table, tuple(sets), self.where())

    def delete(self) -> a.Delete:
        self.expect("DELETE", "FROM")
        return a.Delete(self.name("a table name"), self.where())

    # Queries.

    def query(self) -> a.Query:
        left = self.select()
        for op in ("UNION", "INTERSECT", "EXCEPT"):
            if self.take(op):
                every = self.take("ALL")
                return a.SetOp(op.lower(), every, left, self.query())
        return left

    def select(self) -> a.Select:
        self.expect("SELECT")
        if self.peek() == "DISTINCT":
            raise SqlSyntaxError("Unsupported: DISTINCT")
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        self.expect("FROM")
        table, join = self.name("a table name"), self.join()
        where, group, having, order, limit, offset = self.where(), [], None, [], None, None
        if self.take("GROUP"):
            self.expect("BY")
            group.append(self.column())
            while self.take(","):
                group.append(self.column())
        if self.take("HAVING"):
            having = self.predicate(True)
        if self.take("ORDER"):
            self.expect("BY")
            while True:
                by = self.operand(True)
                order.append(a.OrderItem(by, self.direction()))
                if not self.take(","):
                    break
        for _ in range(2):
            if limit is None and self.take("LIMIT"):
                limit = self.count("LIMIT")
            elif offset is None and self.take("OFFSET"):
                offset = self.count("OFFSET")
        return a.Select(tuple(items), table, join, where, tuple(group), having, tuple(order), limit, offset)

    def direction(self) -> bool:
        return self.take("DESC") or (self.take("ASC") and False)

    def count(self, word: str) -> a.Value:
        v = literal(self.next("a count"))
        if not isinstance(v, a.Param) and (isinstance(v, bool) or not isinstance(v, int) or v < 0):
            raise SqlSyntaxError(f"{word} needs a whole number")
        return v

    def item(self) -> a.Item:
        if self.take("*"):
            return a.Star()
        word = self.peek()
        if word in RANKINGS and self.peek(1) == "(":
            self.at += 1
            self.expect("(", ")", "OVER", "(")
            partition = []
            if self.take("PARTITION"):
                self.expect("BY")
                partition.append(self.column())
                while self.take(","):
                    partition.append(self.column())
            self.expect("ORDER", "BY")
            by, down = self.column(), self.direction()
            self.expect(")")
            return a.Ranking(word.lower(), by, down, tuple(partition))
        return self.operand(True)

    def operand(self, aggregates: bool) -> a.Operand:
        word = self.peek()
        if aggregates and word in AGGREGATES and self.peek(1) == "(":
            self.at += 2
            column = None
            if not self.take("*"):
                column = self.column()
            elif word != "COUNT":
                raise SqlSyntaxError(f"{word}(*) is not defined")
            self.expect(")")
            return a.Aggregate(word.lower(), column)
        return self.column()

    def join(self) -> a.Join | None:
        kind = None
        if self.take("JOIN") or self.take("INNER", "JOIN"):
            kind = "inner"
        for side in ("LEFT", "RIGHT"):
            if self.take(side, "JOIN") or self.take(side, "OUTER", "JOIN"):
                kind = side.lower()
        if not kind:
            return None
        table = self.name("a table name")
        self.expect("ON")
        left = self.column()
        self.expect("=")
        return a.Join(kind, table, left, self.column())

    def where(self) -> a.Predicate | None:
        return self.predicate(False) if self.take("WHERE") else None

    def predicate(self, aggregates: bool) -> a.Predicate:
        out = self.conjunction(aggregates)
        while self.take("OR"):
            out = a.Or(out, self.conjunction(aggregates))
        return out

    def conjunction(self, aggregates: bool) -> a.Predicate:
        out = self.negation(aggregates)
        while self.take("AND"):
            out = a.And(out, self.negation(aggregates))
        return out

    def negation(self, aggregates: bool) -> a.Predicate:
        if self.take("NOT"):
            return a.Not(self.negation(aggregates))
        if self.take("("):
            out = self.predicate(aggregates)
            self.expect(")")
            return out
        return self.condition(aggregates)

    def condition(self, aggregates: bool) -> a.Predicate:
        left = self.operand(aggregates)
        if self.take("IS"):
            negated = self.take("NOT")
            self.expect("NULL")
            return a.IsNull(left, negated)
        if self.take("IN"):
            if self.peek(1) == "SELECT":
                self.expect("(")
                inner = self.query()
                self.expect(")")
                return a.InSelect(left, inner)
            return a.InList(left, self.values())
        op = self.next("an operator")
        known = {"=": "=", "<>": "<>", "!=": "<>", "<": "<", ">": ">", "<=": "<=", ">=": ">=", "LIKE": "like"}
        if op.key not in known:
            raise SqlSyntaxError(f"Unknown operator: {op.text}")
        return a.Compare(left, known[op.key], literal(self.next("a value")))


def parse(sql: str) -> a.Statement:
    try:
        return Parser(sql).parse()
    except RecursionError:
        raise SqlSyntaxError("the statement is nested too deeply") from None
