"""A table function for SQL over JSON of unknown shape."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="path string, kind string, value string", useArrow=True)
class WalkJson:
    """Every value inside a JSON document, depth first in document order: its path, its kind and its text."""

    def eval(self, document: str) -> Iterator[tuple[str, str, str | None]]:
        import json

        try:
            waiting = [("$", json.loads(document or "null"))]
        except ValueError:
            return
        while waiting:
            path, node = waiting.pop()
            if isinstance(node, dict):
                yield path, "object", None
                waiting += [(f"{path}.{name}", v) for name, v in reversed(node.items())]
            elif isinstance(node, list):
                yield path, "array", None
                waiting += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(node)))]
            else:
                kind = "null" if node is None else "boolean" if isinstance(node, bool) else "string" if isinstance(node, str) else "number"
                yield path, kind, None if node is None else node if isinstance(node, str) else json.dumps(node)


@udtf(returnType="place array<int>, item string", useArrow=True)
class ResponseItems:
    """Objects of every items list below result, results and tasks of a response, at any depth.

    place is the path of steps to the item: a node's own items come first (-1),
    then its result, results and tasks (0 to 2) in this order, and positions in
    lists; places so sort in the order in which a response reads. A document
    that isn't JSON has no items.
    """

    def eval(self, document: str) -> Iterator[tuple[list[int], str]]:
        import json

        try:
            waiting = [([], json.loads(document or "null"))]
        except (ValueError, RecursionError):
            return
        while waiting:
            place, node = waiting.pop()
            if isinstance(node, dict):
                own = node.get("items")
                if isinstance(own, list):
                    for pos, item in enumerate(own):
                        if isinstance(item, dict):
                            yield [*place, -1, pos], json.dumps(item)
                waiting += [([*place, step], node[name]) for step, name in reversed(list(enumerate(("result", "results", "tasks")))) if name in node]
            elif isinstance(node, list):
                waiting += [([*place, pos], x) for pos, x in reversed(list(enumerate(node)))]


def register(spark: SparkSession) -> None:
    """walk_json(document) and response_items(document) for SQL."""
    spark.udtf.register("walk_json", WalkJson)
    spark.udtf.register("response_items", ResponseItems)
