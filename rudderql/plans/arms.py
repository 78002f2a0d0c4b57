"""Arms: named ways to plan the same query.

An arm is a set of allowed join and scan strategies. Spark has no switches for
single strategies, so an arm becomes join hints on all aliases of a query and,
where needed, settings that hold while it is planned and run.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession

FLAGS = ("enable_hashjoin", "enable_mergejoin", "enable_nestloop", "enable_indexscan", "enable_seqscan", "enable_indexonlyscan")
#: Whether an arm allows hash join, merge join, nested loop, index scan, sequential scan, index-only scan. There is no arm 6.
ALLOWED = {
    0: (True, True, True, True, True, True),
    1: (True, True, False, True, True, True),
    2: (True, False, True, False, True, True),
    3: (True, False, False, False, True, True),
    4: (False, True, True, True, True, True),
    5: (True, False, True, True, True, True),
    7: (False, True, True, False, False, True),
    8: (True, False, False, False, False, True),
    9: (True, False, True, True, False, True),
    10: (True, False, False, True, True, True),
    11: (True, True, True, False, True, True),
    12: (True, True, False, False, True, True),
    13: (True, False, True, True, False, False),
    14: (False, False, True, True, False, False),
    15: (False, True, True, True, True, False),
    16: (False, False, True, True, False, True),
    17: (True, True, True, True, False, True),
    18: (False, True, True, True, False, False),
    19: (False, True, True, False, True, True),
    20: (False, False, True, True, True, True),
    21: (True, True, False, True, False, True),
    22: (True, True, False, False, False, True),
    23: (True, False, True, True, True, False),
    24: (True, False, False, True, False, False),
    25: (True, False, True, False, False, True),
}
DEFAULT_ARMS = (0, 1, 2, 3, 4, 5)


@dataclass(frozen=True)
class Arm:
    index: int

    def __post_init__(self):
        if self.index not in ALLOWED:
            raise ValueError(f"no arm {self.index}; arms are {sorted(ALLOWED)}")

    @property
    def config(self) -> dict:
        return dict(zip(FLAGS, ALLOWED[self.index], strict=True)) | {"index": self.index}

    @property
    def config_json(self) -> str:
        return json.dumps(self.config)

    @property
    def hint_text(self) -> str:
        """The switches that this arm turns off, as SET statements."""
        return " ".join(f"SET {f} TO off;" for f in FLAGS if not self.config[f])

    def hints(self, aliases: list[str], facts: list[str] = ()) -> str:
        """Join hints: hash and nested loop allow broadcasting, merge alone sorts, hash alone builds by shuffle."""
        c, names, big = self.config, ", ".join(aliases), [a for a in aliases if a in facts]
        hash_, merge, loop = c["enable_hashjoin"], c["enable_mergejoin"], c["enable_nestloop"]
        if hash_ and merge and loop:
            return ""
        if merge and (hash_ or not big):
            return f"MERGE({names})"
        if merge:
            return f"MERGE({', '.join(big)})"
        if hash_ and loop:
            small = [a for a in aliases if a not in facts]
            if c["enable_indexscan"] and big and small:
                return f"BROADCAST({', '.join(small)}), SHUFFLE_HASH({', '.join(big)})"
            return f"SHUFFLE_HASH({names})" if big and not small else f"BROADCAST({', '.join(small)})"
        return f"SHUFFLE_HASH({names})" if hash_ else f"SHUFFLE_MERGE({names})"

    @property
    def settings(self) -> dict:
        """AQE could change the join after the choice, so it is off but for arm 0; without hash joins nothing is broadcast."""
        if self.index == 0:
            return {}
        return {"spark.sql.adaptive.enabled": "false"} | ({} if self.config["enable_hashjoin"] else {"spark.sql.autoBroadcastJoinThreshold": "-1"})


@contextmanager
def settings(spark: SparkSession, values: dict) -> Iterator[None]:
    """Hold ``values`` inside the block and put back what was there."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: A string or a quoted name (group 1), or a comment.
_QUOTED_OR_COMMENT = r"""(?s)('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`)|--[^\n]*|/\*(?!\+).*?\*/"""


def uncommented(sql: str) -> str:
    """``sql`` without comments; what looks like one inside a string stays."""
    return re.sub(_QUOTED_OR_COMMENT, lambda m: m[1] or " ", sql).strip()


def with_hint(sql: str, hint: str) -> str:
    """``sql`` with the hint after its first SELECT; comments go."""
    return re.sub(r"(?i)\bselect\b", lambda m: f"{m[0]} /*+ {hint} */", uncommented(sql), count=1) if hint else sql


def aliases(sql: str, spark: SparkSession | None = None) -> list[str]:
    """Aliases (else names) of the relations in the outermost FROM, as the parser sees them; [] if it has none or is no query."""
    from pyspark.errors import ParseException

    from .catalyst import from_names, parse

    try:
        return from_names(parse(spark or SparkSession.active(), sql))
    except ParseException:
        return []
