"""A search as data: conditions in groups, scopes, sort and page; and its parsing from request parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVE = ("contains", "equals", "starts")
#: Fields that name rows of a many-to-many relation.
RELATIONS = ("keywords", "recipe_lists")


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: str

    @property
    def binds_a_row(self) -> bool:
        """Whether it holds of some related row (a negated one instead holds if no related row matches)."""
        return self.field in RELATIONS and self.op in POSITIVE


@dataclass(frozen=True)
class Group:
    logic: str
    conditions: tuple[Condition, ...]


@dataclass(frozen=True)
class Search:
    text: str = ""
    groups: tuple[Group, ...] = ()
    group_logic: str = "or"
    book: Any = None
    lists: tuple = ()
    keywords: tuple[str, ...] = ()
    #: (recipe_id, rank) of a vector search; None: no vector search. An empty one finds nothing unless empty_ranked_is_no_filter.
    ranked: DataFrame | None = None
    empty_ranked_is_no_filter: bool = False
    sort: str | None = None
    seed: int = 0
    page: int = 1
    per_page: int = 30

    @property
    def default_sort(self) -> str:
        if self.ranked is not None:
            return "relevance"
        if self.book is not None:
            return "order"
        return "list_order" if len(self.lists) == 1 else "recent"


def text_predicate(column: Column, op: str, value: str) -> Column | None:
    """Case-insensitive comparison of text, wildcards taken literally; not_contains keeps nulls; None for an unknown op."""
    have, want = F.lower(column), F.lower(F.lit(value))
    if op == "contains":
        return F.contains(have, want)
    if op == "not_contains":
        return ~F.coalesce(F.contains(have, want), F.lit(False))
    if op == "equals":
        return have == want
    if op == "starts":
        return F.startswith(have, want)
    return None


def parse_groups(fields: Sequence[str], ops: Sequence[str], values: Sequence[str], groups: Sequence[str], logics: Sequence[str]) -> tuple[Group, ...]:
    """Groups from five parallel lists, of which the shortest counts: blank values are passed over, a group that is no
    number is 0, a group's logic is that of its first condition, groups come in the order of their numbers."""
    found: dict[int, tuple[str, list[Condition]]] = {}
    for name, op, value, group, logic in zip(fields, ops, values, groups, logics):
        if value.strip():
            found.setdefault(int(group) if group.isdigit() else 0, (logic, []))[1].append(Condition(name, op, value.strip()))
    return tuple(Group(logic, tuple(conditions)) for _, (logic, conditions) in sorted(found.items()))


def parse(params: Mapping[str, Any]) -> Search:
    """A search from request parameters, lists under names that end in []."""
    many = lambda name: list(params.get(f"{name}[]", ()))
    lists = many("selected_lists")
    if params.get("list") and params["list"] not in lists:
        lists.append(params["list"])
    groups = parse_groups(*(many(f"filter_{x}") for x in ("field", "op", "value", "group", "logic")))
    return Search(
        text=params.get("q", "").strip(),
        groups=groups,
        group_logic=params.get("group_logic", "or"),
        book=params.get("book") or None,
        lists=tuple(lists),
        keywords=tuple(many("selected_keywords")),
        sort=params.get("sort"),
        page=page_number(params.get("page", 1)),
    )


def page_number(value: Any) -> int:
    """A page that is no number is the first."""
    try:
        return max(1, int(value))
    except (TypeError, ValueError):
        return 1
