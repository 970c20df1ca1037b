"""Incremental differences over a stream of file versions.

State is, for each path, the hash of every symbol's source in its last version; each new version gives the symbols that are new or
changed and those that are gone. Text never stays in the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from xxhash import xxh64_hexdigest

from ..operators.parse import symbols_of

SCHEMA = "path string, version long, name string, change string, full_source string"
STATE = "names array<string>, hashes array<string>"


def changes(versions: DataFrame) -> DataFrame:
    """versions (path, version, language, content), a stream -> a row for each symbol added, changed or removed. Versions of a path are
    taken in their order within a batch; late ones are compared with what came before them."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get)) if state.exists else {}
        out = []
        for r in pd.concat(list(frames)).sort_values("version", kind="stable").itertuples():
            now = {s["name"]: s["full_source"] for s in symbols_of(r.content or "", r.language)}
            marks = {n: xxh64_hexdigest(t) for n, t in now.items()}
            for n, t in now.items():
                if known.get(n) != marks[n]:
                    out.append((key[0], r.version, n, "changed" if n in known else "added", t))
            out += [(key[0], r.version, n, "removed", None) for n in known if n not in now]
            known = marks
        state.update((list(known), list(known.values())))
        yield pd.DataFrame(out, columns=["path", "version", "name", "change", "full_source"])

    return versions.groupBy("path").applyInPandasWithState(step, SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)
