"""Results of Spark and DuckDB as sorted plain rows."""

import math


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, list):
            return str(x)
        if isinstance(x, float) and math.isnan(x):
            return "nan"
        return x

    return list(frame.columns), sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=str)
