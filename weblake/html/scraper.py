"""Declarative scrapers: a validated definition, its schema, and its interpretation on a tree."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from weblake.html.tree import Element, SelectorError, compiled, display_text, select, select_one

#: Keys of a definition, each with its short form.
SELECTOR, ITERATOR = ("sel", "$"), ("iterator", "$$")
EXTRACTORS: dict[str, Callable[[Element], str]] = {
    "text": Element.text,
    "display_text": display_text,
    "html": Element.inner_html,
    "inner_html": Element.inner_html,
    "outer_html": Element.outer_html,
}
PLURAL_ONLY = ("filter", "filter_eval", "uniq")
KNOWN = {*SELECTOR, *ITERATOR, "item", "fields", "attr", "extract", "default", "filter", "uniq", "set_context", "get_context", "sel_eval", "iterator_eval", "eval", "filter_eval", "tabulate"}
HOOKS = ("sel_eval", "iterator_eval", "eval", "filter_eval")


class InvalidDefinition(ValueError):
    pass


def _one_of(d: dict, keys: tuple[str, ...]) -> Any:
    return next((d[k] for k in keys if k in d), None)


def validate(definition: Any, where: str = "scraper") -> None:
    """Raises InvalidDefinition for unknown or conflicting keys, bad extractors and selectors, plural keys without iterator."""
    if isinstance(definition, str):
        if definition not in EXTRACTORS and not definition.replace("-", "").replace("_", "").isalnum():
            raise InvalidDefinition(f"{where}: bad extractor {definition}")
        return
    if callable(definition):
        return
    if not isinstance(definition, dict):
        raise InvalidDefinition(f"{where}: a definition is a mapping")
    if unknown := set(definition) - KNOWN:
        raise InvalidDefinition(f"{where}: unknown keys {sorted(unknown)}")
    for a, b in ((SELECTOR[0], SELECTOR[1]), (ITERATOR[0], ITERATOR[1]), ("item", "fields"), ("attr", "extract"), ("sel", "sel_eval"), ("iterator", "iterator_eval")):
        if a in definition and b in definition:
            raise InvalidDefinition(f"{where}: {a} and {b} conflict")
    for h in HOOKS:
        if h in definition and not callable(definition[h]):
            raise InvalidDefinition(f"{where}: {h} must be a function; text is not evaluated")
    for s in (*SELECTOR, *ITERATOR):
        if s in definition:
            try:
                compiled(definition[s])
            except SelectorError as e:
                raise InvalidDefinition(f"{where}: {e}") from e
    if "extract" in definition and definition["extract"] not in EXTRACTORS:
        raise InvalidDefinition(f"{where}: bad extractor {definition['extract']}")
    if not is_plural(definition) and any(k in definition for k in PLURAL_ONLY):
        raise InvalidDefinition(f"{where}: {', '.join(k for k in PLURAL_ONLY if k in definition)} without an iterator")
    table = definition.get("tabulate")
    if isinstance(table, dict) and set(table) - {"headers", "headers_inference"} or table is not None and not isinstance(table, bool | dict):
        raise InvalidDefinition(f"{where}: tabulate is true or a mapping of headers and headers_inference")
    if table and any(k in definition for k in ("item", "fields", "attr", "extract")):
        raise InvalidDefinition(f"{where}: tabulate conflicts with what else makes a value")
    if "item" in definition:
        validate(definition["item"], f"{where}.item")
    for name, field in definition.get("fields", {}).items():
        validate(field, f"{where}.{name}")


def is_plural(definition: dict) -> bool:
    return isinstance(definition, dict) and any(k in definition for k in (*ITERATOR, "iterator_eval"))


def field_names(definition: dict) -> list[str] | None:
    """Columns of the result: ``value`` without fields; None if the fields hold fields of their own."""
    inner = definition.get("item") if isinstance(definition.get("item"), dict) else definition
    fields = inner.get("fields") if isinstance(inner, dict) else None
    if fields is None:
        return ["value"]
    nested = any(isinstance(f, dict) and ("fields" in f or isinstance(f.get("item"), dict)) for f in fields.values())
    return None if nested else list(fields)


def _at(value: Any, path: str) -> Any:
    for part in path.split("."):
        value = value.get(part) if isinstance(value, dict) else None
    return value


def tabulated(table: Element, headers: list[str] | None = None, headers_inference: str | None = "th") -> list | None:
    """Rows of a table: mappings from header to text, or, without any headers, lists of texts; None of what is no table.

    Headers are given, or the ``th`` of its ``thead`` (without one, of the table); cells beyond them go by number.
    """
    if table.name != "table":
        return None
    part = lambda name: next((c for c in table.children if isinstance(c, Element) and c.name == name), table)
    cells = lambda row, name: [c for c in row.children if isinstance(c, Element) and c.name == name]
    if headers is None and headers_inference == "th":
        headers = [th.text() for th in part("thead").walk() if th.name == "th" and th.parent.name == "tr"]
    rows = [[td.text() for td in found] for tr in part("tbody").walk() if tr.name == "tr" and (found := cells(tr, "td"))]
    if headers is None:
        return rows
    return [{(headers[i] if i < len(headers) else str(i)): t for i, t in enumerate(row)} for row in rows]


class Interpreter:
    """Runs a definition on one page's tree."""

    def __init__(self, root: Element, context: dict[str, Any] | None = None):
        self.root, self.context = root, dict(context or {})

    def hook(self, f: Callable, element: Element | None, value: Any = None) -> Any:
        return f(element=element, value=value, context=self.context, root=self.root)

    def run(self, d: dict, element: Element | None = None) -> Any:
        element = self.root if element is None else element
        if sel := _one_of(d, SELECTOR):
            element = select_one(element, sel)
        elif "sel_eval" in d:
            found = self.hook(d["sel_eval"], element)
            element = select_one(element, found) if isinstance(found, str) else found
        if not is_plural(d):
            return None if element is None else self.finished(d, element)
        if element is None:
            return []
        it = _one_of(d, ITERATOR)
        items = select(element, it) if it else self.hook(d["iterator_eval"], element)
        if isinstance(items, str):
            items = select(element, items)
        out, seen = [], set()
        for e in items:
            v = self.finished(d, e)
            if not self.passes(d, e, v):
                continue
            if d.get("uniq"):
                key = repr(v if d["uniq"] is True else _at(v, d["uniq"]))
                if key in seen:
                    continue
                seen.add(key)
            out.append(v)
        return out

    def passes(self, d: dict, element: Element, value: Any) -> bool:
        wanted = d.get("filter")
        if wanted and not (value if wanted is True else _at(value, wanted)):
            return False
        return bool(self.hook(d["filter_eval"], element, value)) if "filter_eval" in d else True

    def finished(self, d: dict, element: Element) -> Any:
        for name, sub in d.get("set_context", {}).items():
            self.context[name] = self.run(sub, element) if isinstance(sub, dict) else self.value(sub, element)
        value = self.value(d, element)
        if "eval" in d:
            value = self.hook(d["eval"], element, value)
        return d["default"] if value is None and "default" in d else value

    def value(self, d: Any, element: Element) -> Any:
        if callable(d):
            return self.hook(d, element)
        if isinstance(d, str):
            return EXTRACTORS[d](element) if d in EXTRACTORS else element.attrs.get(d)
        if "get_context" in d:
            return self.context.get(d["get_context"])
        if "fields" in d:
            return {k: self.run(f, element) if isinstance(f, dict) else self.value(f, element) for k, f in d["fields"].items()}
        if "item" in d:
            return self.run(d["item"], element) if isinstance(d["item"], dict) else self.value(d["item"], element)
        if d.get("tabulate"):
            return tabulated(element, **(d["tabulate"] if isinstance(d["tabulate"], dict) else {}))
        if "attr" in d:
            return element.attrs.get(d["attr"])
        return EXTRACTORS[d.get("extract", "text")](element)
