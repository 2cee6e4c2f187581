"""Nested JSON documents: recursive harvest."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.jsontext import read_strict


class Harvest:
    """Every object, at any depth, whose first wanted field that isn't empty is a text: (text, path, id, record). Fields are tried in
    order, and one that holds something else than a text hides those after it. A document that isn't strict JSON gives one row with
    a null text and the path of the fault."""

    def eval(self, document: str, fields: str) -> Iterator[tuple]:
        if document is None:
            return
        try:
            stack = [("$", read_strict(document))]
        except (ValueError, RecursionError):
            yield None, "not strict JSON", None, None
            return
        wanted = fields.split(",")
        while stack:
            path, value = stack.pop()
            if isinstance(value, dict):
                text = next((value[f] for f in wanted if value.get(f)), None)
                if isinstance(text, str):
                    own = value.get("id")
                    yield text, path, None if own is None else str(own), json.dumps(value, ensure_ascii=False)
                stack += [(f"{path}.{k}", v) for k, v in reversed(value.items())]
            elif isinstance(value, list):
                stack += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(value)))]


def harvest(documents: DataFrame, column: str, fields: tuple[str, ...] = ("prompt", "user_message")) -> DataFrame:
    """All texts in the wanted fields of JSON documents, with the other columns, the object's id and its JSON."""
    found = udtf(Harvest, returnType="text string, path string, record_id string, record string")
    documents.sparkSession.udtf.register("curalens_harvest", found)
    return documents.selectExpr("*").lateralJoin(found(F.col(column).outer(), F.lit(",".join(fields))))
