"""Recursive descent over tokens, for schemas and queries."""

from __future__ import annotations

from typing import Any

from ..errors import WeftError
from .ast import And, Call, Compare, Const, Exists, Field, Link, ListOf, Or, Param, Path, Query, Record, Schema, Selection, SessionPath, TypeRef, Union, Variant, VariantValue
from .lexer import Token, tokenize, unquote

_COMPARE = {"==": "==", "=": "==", "!=": "!=", ">": ">", "<": "<", ">=": ">=", "<=": "<="}
_WORDS = {"True": True, "False": False, "true": True, "false": False, "null": None}


class _Parser:
    def __init__(self, source: str):
        self.tokens = tokenize(source)
        self.at = 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def take(self, text: str | None = None, kind: str | None = None) -> Token:
        t = self.now
        if (text is not None and t.text != text) or (kind is not None and t.kind != kind):
            raise WeftError("ParsingError", f"line {t.line}: expected {text or kind}, found {t.text or 'the end'!r}")
        self.at += 1
        return t

    def took(self, text: str) -> bool:
        if self.now.text == text and self.now.kind not in ("string", "end"):
            self.at += 1
            return True
        return False

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    # --- values ---

    def value(self) -> Any:
        t = self.now
        if t.kind == "string":
            self.at += 1
            return Const(unquote(t.text))
        if t.kind == "number":
            self.at += 1
            return Const(float(t.text) if "." in t.text else int(t.text))
        if t.kind == "param":
            self.at += 1
            return Param(t.text[1:])
        if self.took("["):
            items = []
            while not self.took("]"):
                items.append(self.value())
                self.took(",")
            return ListOf(tuple(items))
        name = self.take(kind="name").text
        if name in _WORDS:
            return Const(_WORDS[name])
        if self.took("("):
            args = []
            while not self.took(")"):
                args.append(self.value())
                self.took(",")
            return Call(name, tuple(args))
        parts = [name]
        while self.took("."):
            parts.append(self.take(kind="name").text)
        if parts[0] == "Session" and len(parts) > 1:
            return SessionPath(tuple(parts[1:]))
        return Path(tuple(parts))

    # --- predicates ---

    def block(self) -> Any:
        """A block in braces: lines and commas mean and."""
        self.take("{")
        self.took("||")  # may lead a chain
        parts = []
        while not self.took("}"):
            parts.append(self.chain())
            self.took(",")
        if not parts:
            raise WeftError("ParsingError", f"line {self.now.line}: an empty condition")
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def chain(self) -> Any:
        """Terms joined by && and ||, strictly from left to right."""
        left = self.term()
        while self.now.text in ("&&", "||") and self.now.kind == "op":
            kind = And if self.take().text == "&&" else Or
            left = kind((left, self.term()))
        return left

    def term(self) -> Any:
        t = self.now
        if t.kind == "name" and t.text in ("And", "Or") and self.ahead().text == "(":
            self.at += 2
            parts = []
            while not self.took(")"):
                parts.append(self.chain())
                self.took(",")
            if len(parts) < 2:
                raise WeftError("ParsingError", f"line {t.line}: {t.text} takes two conditions or more")
            return (And if t.text == "And" else Or)(tuple(parts))
        if self.took("("):
            inner = self.chain()
            self.take(")")
            return inner
        if t.text == "exists" and self.ahead().kind == "name":
            self.at += 1
            links = [self.take(kind="name").text]
            while self.took("."):
                links.append(self.take(kind="name").text)
            return Exists(tuple(links), self.block())
        left = self.value()
        op = self.now
        if op.text in _COMPARE and op.kind == "op":
            self.at += 1
            return Compare(_COMPARE[op.text], left, self.value())
        if op.text == "in" and op.kind == "name":
            self.at += 1
            return Compare("in", left, self.value())
        if op.text == "not" and self.ahead().text in ("in", "like"):
            self.at += 2
            return Compare(f"not {self.tokens[self.at - 1].text}", left, self.value())
        if op.text == "like" and op.kind == "name":
            self.at += 1
            return Compare("like", left, self.value())
        if isinstance(left, Const) and isinstance(left.value, bool):
            return left
        raise WeftError("ParsingError", f"line {op.line}: expected a comparison")

    # --- types ---

    def type(self) -> TypeRef:
        parts = [self.take(kind="name").text]
        while self.took("."):
            parts.append(self.take(kind="name").text)
        args = []
        if self.took("<"):
            while not self.took(">"):
                args.append(self.type())
                self.took(",")
        return TypeRef(".".join(parts), tuple(args), self.took("?"))

    # --- schemas ---

    def schema(self) -> Schema:
        out = Schema()
        while self.now.kind != "end":
            t = self.take()
            if t.text == "@syncable":
                self.take("(")
                out.syncable = self.take(kind="name").text not in ("false", "False")
                self.take(")")
            elif t.text == "session":
                self.take("{")
                while not self.took("}"):
                    out.session.append(Field(self.take(kind="name").text, self.type()))
            elif t.text == "type":
                union = self.union()
                if union.name in out.unions:
                    raise WeftError("DuplicateDefinition", union.name)
                out.unions[union.name] = union
            elif t.text == "record":
                record = self.record()
                if record.name in out.records:
                    raise WeftError("DuplicateDefinition", record.name)
                out.records[record.name] = record
            else:
                raise WeftError("ParsingError", f"line {t.line}: expected session, type or record, found {t.text!r}")
        return out

    def union(self) -> Union:
        name = self.take(kind="name").text
        self.take("=")
        variants = []
        while True:
            variant = Variant(self.take(kind="name").text, [])
            if self.took("{"):
                while not self.took("}"):
                    variant.fields.append(Field(self.take(kind="name").text, self.type()))
                    self.took(",")
            if any(v.name == variant.name for v in variants):
                raise WeftError("DuplicateVariant", variant.name)
            variants.append(variant)
            if not self.took("|"):
                return Union(name, variants)

    def arguments(self) -> list:
        out = []
        if self.took("("):
            while not self.took(")"):
                words = []
                while self.now.text not in (",", ")"):
                    words.append("*" if self.took("*") else self.value())
                out.append(words[0] if len(words) == 1 else tuple(words))
                self.took(",")
        return out

    def record(self) -> Record:
        out = Record(self.take(kind="name").text, [], [], [])
        self.take("{")
        while not self.took("}"):
            t = self.now
            if t.kind == "at":
                self.at += 1
                args = self.arguments()
                block = None
                if self.now.text == "where" and self.ahead().text == "{":
                    self.at += 1
                    block = self.block()
                elif t.text == "@allow":
                    block = self.block()
                out.directives.append((t.text[1:], [a.value if isinstance(a, Const) else a for a in args], block))
                continue
            name = self.take(kind="name").text
            if self.now.text == "@link":
                self.at += 1
                out.links.append(self.link(name, self.arguments()))
                continue
            found = Field(name, self.type())
            while self.now.kind == "at" and not self.now.first:
                directive = self.take().text[1:]
                found.directives[directive] = self.arguments()
            if any(f.name == name for f in out.fields):
                raise WeftError("DuplicateField", f"{out.name}.{name}")
            out.fields.append(found)
        return out

    def link(self, name: str, args: list) -> Link:
        """``@link(Post.authorId)`` from the key, or ``@link(authorId, User.id)``; several fields pairwise."""
        local = [a.parts[0] for a in args if isinstance(a, Path) and len(a.parts) == 1]
        far = [a.parts for a in args if isinstance(a, Path) and len(a.parts) > 1]
        if not far or (local and len(local) != len(far)):
            raise WeftError("ParsingError", f"link {name} needs as many foreign fields as local ones")
        return Link(name, local, far[0][-2], [p[-1] for p in far], far[0][0] if len(far[0]) > 2 else None)

    # --- queries ---

    def queries(self) -> list[Query]:
        out = []
        while self.now.kind != "end":
            kind = self.take(kind="name").text
            if kind not in ("query", "insert", "update", "delete"):
                raise WeftError("ParsingError", f"line {self.now.line}: expected query, insert, update or delete, found {kind!r}")
            name = self.take(kind="name").text
            params: dict[str, TypeRef] = {}
            if self.took("("):
                while not self.took(")"):
                    p = self.take(kind="param").text[1:]
                    if p in params:
                        raise WeftError("DuplicateParameter", p)
                    params[p] = self.type() if self.took(":") else TypeRef("Any")
                    self.took(",")
            self.take("{")
            roots = []
            while not self.took("}"):
                roots.append(self.selection())
            out.append(Query(kind, name, params, roots))
        return out

    def selection(self) -> Selection:
        if self.took("*"):
            return Selection("*", "*")
        name = alias = self.take(kind="name").text
        if self.took(":"):
            name = self.take(kind="name").text
        out = Selection(name, alias)
        if self.took("="):
            out.value, out.assigned = self.assigned(), True
            return out
        if self.took("{"):
            out.children = []
            while not self.took("}"):
                if self.now.kind == "at":
                    self.argument(out)
                else:
                    out.children.append(self.selection())
                    self.took(",")
        return out

    def assigned(self) -> Any:
        value = self.value()
        if isinstance(value, Path) and len(value.parts) == 1:
            fields = []
            if self.took("{"):
                while not self.took("}"):
                    name = self.take(kind="name").text
                    self.take("=")
                    fields.append((name, self.assigned()))
                    self.took(",")
            return VariantValue(value.parts[0], tuple(fields))
        return value

    def argument(self, out: Selection) -> None:
        t = self.take()
        if t.text == "@where":
            out.wheres.append(self.block())
        elif t.text == "@sort":
            self.take("(")
            name = self.take(kind="name").text
            way = "Asc"
            if self.took(","):
                way = self.take(kind="name").text
            self.take(")")
            if way.lower() not in ("asc", "desc"):
                raise WeftError("ParsingError", f"line {t.line}: sort is Asc or Desc")
            out.sorts.append((name, way.lower()))
        elif t.text == "@limit":
            self.take("(")
            out.limits.append(self.value())
            self.take(")")
        else:
            raise WeftError("ParsingError", f"line {t.line}: unknown argument {t.text}")


def parse_schema(source: str) -> Schema:
    return _Parser(source).schema()


def parse_queries(source: str) -> list[Query]:
    return _Parser(source).queries()


def parse_predicate(source: str) -> Any:
    """A condition as it stands between braces."""
    return _Parser("{" + source + "}").block()
