"""Keyed state for streaming operators (O-70, O-72, O-73, O-59).

Processors for ``groupBy(bucket).transformWithStateInPandas``.  A bucket
holds the keys of one hash value, so that a call, its frames and its
exchanges with the state store serve many keys.  Each call receives a
bucket's rows of one micro-batch, sorted by key and time; state is read
and written once for each key that has rows (windows, which expire: once for
the bucket).  A key costs its rows of the micro-batch and its own state,
whose lists of values seen grow with their number, never with its rows.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATS_SCHEMA = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("nv", T.LongType()),
    T.StructField("mean", T.DoubleType()), T.StructField("m2", T.DoubleType()),
    T.StructField("last_us", T.LongType()),
])
ACCOUNT_KEY = T.StructType([T.StructField("v", T.StringType())])
#: The values seen of each kind, as JSON.
ACCOUNT_VAL = T.StructType([*STATS_SCHEMA.fields, T.StructField("seen", T.BinaryType())])


def _spans(keys: Sequence[str]) -> list[tuple[str, int, int]]:
    """(key, first place, place behind the last) of sorted keys."""
    a = np.asarray(keys, dtype=object)
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1])).tolist()
    return [(a[i], i, j) for i, j in zip(starts, [*starts[1:], len(a)])]


def _us(ts: pd.Series) -> np.ndarray:
    if ts.dtype.kind == "i":  # already micros
        return ts.to_numpy()
    return ts.astype("datetime64[us]").astype("int64").to_numpy()


def prior_stats(x: np.ndarray, n0: int, mean0: float, m2_0: float):
    """Exclusive running (count, mean, M2) of the known values of ``x`` after
    a prefix state, merged with Chan's formula; shifted sums keep it stable."""
    known = ~np.isnan(x)
    k = mean0 if n0 else (x[known][0] if known.any() else 0.0)
    d = np.where(known, x - k, 0.0)
    c = np.concatenate([[0.0], np.cumsum(known)[:-1]])       # known values of this batch before i
    s1 = np.concatenate([[0.0], np.cumsum(d)[:-1]])
    s2 = np.concatenate([[0.0], np.cumsum(d * d)[:-1]])
    with np.errstate(invalid="ignore", divide="ignore"):
        mb = np.where(c > 0, k + s1 / np.where(c > 0, c, 1), 0.0)
        m2b = np.where(c > 0, s2 - s1 * s1 / np.where(c > 0, c, 1), 0.0)
    n = n0 + c
    delta = mb - mean0
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(c == 0, mean0, np.where(n0 == 0, mb, mean0 + delta * c / np.where(n > 0, n, 1)))
        m2 = np.where(c == 0, m2_0, np.where(n0 == 0, m2b, m2_0 + m2b + delta * delta * n0 * c / np.where(n > 0, n, 1)))
    return n, mean, np.maximum(m2, 0.0)


class AccountFeatureProcessor(StatefulProcessor):
    """O-70: the 16-column past-only feature row, state read -> emit -> update.

    State per account: counts, Welford mean/M2, the last timestamp and the
    values seen of each tracked kind (receivers, receiver banks, payment
    formats, currencies). Rows carry their account as text in ``key`` and the
    kinds as text in ``<kind>_text``, so a null changes no other value.
    """

    def __init__(self, key: str = "key_text", ts: str = "ts", tie: Sequence[str] = ("row_id",),
                 keep: Sequence[str] = ("row_id",), seen: Sequence[str] = ("receiver", "to_bank", "payment_channel")):
        self.key, self.ts, self.tie, self.keep, self.seen_cols = key, ts, list(tie), list(keep), list(seen)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accounts = handle.getMapState("accounts", ACCOUNT_KEY, ACCOUNT_VAL)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values([self.key, self.ts, *self.tie], kind="mergesort")
        m = len(pdf)
        x = pdf["amount"].to_numpy(dtype=np.float64)
        ts = pdf[self.ts]
        timed = ts.notna().to_numpy()  # rows without a time are last, have no gap and leave none
        us = _us(ts)
        n, mean, m2 = np.zeros(m), np.zeros(m), np.zeros(m)
        prior_n, prev, has_prev = np.zeros(m, dtype="int64"), np.zeros(m, dtype="int64"), np.zeros(m, dtype=bool)
        values = {c: pdf[f"{c}_text"].tolist() for c in self.seen_cols}
        first = {c: np.zeros(m, dtype="int32") for c in self.seen_cols}
        for account, i, j in _spans(pdf[self.key].tolist()):
            if self.accounts.containsKey((account,)):
                n0, nv0, mean0, m2_0, last0, seen = self.accounts.getValue((account,))
                seen = json.loads(bytes(seen))
            else:
                n0, nv0, mean0, m2_0, last0, seen = 0, 0, 0.0, 0.0, None, {c: [] for c in self.seen_cols}
            # the state before each row, and after the last
            nb, mb, m2b = prior_stats(np.append(x[i:j], 0.0), nv0, mean0, m2_0)
            n[i:j], mean[i:j], m2[i:j] = nb[:-1], mb[:-1], m2b[:-1]
            prior_n[i:j] = n0 + np.arange(j - i)
            prev[i], has_prev[i] = (0, False) if last0 is None else (last0, timed[i])
            prev[i + 1:j], has_prev[i + 1:j] = us[i:j - 1], timed[i:j - 1] & timed[i + 1:j]
            last0 = int(us[i:j][timed[i:j]][-1]) if timed[i:j].any() else last0
            for c in self.seen_cols:
                known = dict.fromkeys(seen[c])
                for at, v in enumerate(values[c][i:j], i):
                    if v not in known:
                        known[v] = None
                        first[c][at] = 1
                seen[c] = list(known)
            self.accounts.updateValue((account,), (int(n0 + j - i), int(nb[-1]), float(mb[-1]), float(m2b[-1]), last0,
                                                   json.dumps(seen).encode()))
        with np.errstate(invalid="ignore", divide="ignore"):
            sd = np.where(n < 2, 1.0, np.maximum(np.sqrt(np.maximum(m2 / np.where(n > 1, n - 1, 1), 0.0)), 1.0))
            z = np.where(n < 2, 0.0, (x - mean) / sd)
        tslt = np.where(has_prev, np.maximum(0.0, (us - np.where(has_prev, prev, us)) / 1e6), 0.0)
        dow = ts.dt.dayofweek.astype("Int32")
        out = {c: pdf[c].to_numpy() for c in self.keep}
        out.update({
            "amount": x, "payment_channel": pdf["payment_channel"].to_numpy(),
            "time_since_last_transaction": tslt, "velocity_score": prior_n,
            "spending_deviation_score": z, "is_first_transaction": (prior_n == 0).astype("int32"),
            "hour": ts.dt.hour.astype("Int32").array, "day_of_week": dow.array,
            "month": ts.dt.month.astype("Int32").array, "is_weekend": (dow >= 5).astype("Int32").array,
            "is_fraud": pdf["is_fraud"].to_numpy().astype("int32"),
            "is_cross_bank_transfer": (pdf["from_bank"] != pdf["to_bank"]).to_numpy().astype("int32"),
            "is_cross_currency_transfer": ((pdf["payment_currency"] != pdf["receiving_currency"]).to_numpy()
                                           if "payment_currency" in pdf else np.zeros(m, dtype=bool)).astype("int32"),
        })
        names = {"receiver": "is_new_receiver", "to_bank": "is_new_bank", "payment_channel": "is_new_payment_format"}
        out.update({names.get(c, f"is_new_{c}"): first[c] for c in self.seen_cols})
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


#: The open windows of a bucket as JSON: {key: [start, count, first result]} and the time of its timer.
WINDOW_SCHEMA = T.StructType([T.StructField("windows", T.BinaryType())])


class AnchoredWindowProcessor(StatefulProcessor):
    """O-73 / O-59: fixed-length windows anchored at the first hit after the
    previous window expired.  Emits each row with its window start, its
    count inside the window, and ``allowed = count <= limit``.  With
    ``limit = 1`` it is the idempotency rule: the first call per key wins
    for the window length, later calls are duplicates; each row also gets
    ``result``, what the call that opened its window had there.

    Rows of several keys carry theirs as text in ``key``. With event time
    (``expire``) windows that the watermark has passed leave the state, and a
    timer at the end of a bucket's first window removes them when no row
    comes, so state holds live windows only."""

    def __init__(self, ts: str, length_us: int, limit: int, keep: Sequence[str], tie: Sequence[str] = (), result: str | None = None,
                 expire: bool = False, key: str | None = None):
        self.ts, self.length, self.limit, self.keep, self.tie = ts, length_us, limit, list(keep), list(tie)
        self.result, self.expire, self.key = result, expire, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.win = handle, handle.getValueState("windows", WINDOW_SCHEMA)

    def read(self) -> tuple[dict, int | None]:
        windows, timer = json.loads(bytes(self.win.get()[0])) if self.win.exists() else ({}, None)
        return windows, timer

    def write(self, windows: dict, timer: int | None) -> None:
        if self.expire and timer is None:
            timer = -(-(min(w[0] for w in windows.values()) + self.length) // 1000)
            self.handle.registerTimer(timer)
        self.win.update((json.dumps([windows, timer]).encode(),))

    def live(self, windows: dict, passed_ms: int) -> dict:
        """Later rows are newer than the watermark, so they'd open a new window."""
        return {k: w for k, w in windows.items() if w[0] + self.length > passed_ms * 1000}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = expiredTimerInfo.getExpiryTimeInMs()
        windows, timer = self.read()
        left = self.live(windows, max(at, timerValues.getCurrentWatermarkInMs()))
        if left:
            self.write(left, None if timer == at else timer)
        elif self.win.exists():
            self.win.clear()
        return iter([])

    def handleInputRows(self, key, rows, timerValues):
        by = [self.key] if self.key else []
        pdf = pd.concat(list(rows), ignore_index=True).sort_values([*by, self.ts, *self.tie], kind="mergesort")
        us = _us(pdf[self.ts]).tolist()
        windows, timer = self.read()
        results = [None if v is None or v is pd.NA or v != v else str(v) for v in pdf[self.result]] if self.result else None
        given, starts, counts = [], [], []
        for k, i, j in _spans(pdf[self.key].tolist() if self.key else [""] * len(us)):
            start, count, first = windows.get(k, (None, 0, None))
            for at in range(i, j):
                if start is None or us[at] >= start + self.length:
                    start, count, first = us[at], 0, results[at] if results else None
                count += 1
                starts.append(start)
                counts.append(count)
                given.append(first)
            windows[k] = [start, count, first]
        self.write(windows, timer)
        out = {c: pdf[c].to_numpy() for c in self.keep}
        out["window_start_us"] = np.array(starts, dtype="int64")
        out["count_in_window"] = np.array(counts, dtype="int64")
        out["allowed"] = out["count_in_window"] <= self.limit
        if self.result:
            out["result"] = given
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


RUNNING_SCHEMA = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("nv", T.LongType()),
    # exact sums of any size, as decimal strings
    T.StructField("cents", T.StringType()), T.StructField("cents2", T.StringType()),
    T.StructField("days", T.LongType()), T.StructField("last_day", T.LongType()),
    T.StructField("from_hour", T.IntegerType()), T.StructField("to_hour", T.IntegerType()), T.StructField("last_us", T.LongType()),
    T.StructField("recent", T.BinaryType()),
    T.StructField("method", T.StringType()), T.StructField("method_n", T.LongType()),
    T.StructField("place", T.StringType()), T.StructField("place_n", T.LongType()),
    T.StructField("uses", T.BinaryType()),  # [value, count] of each kind, as JSON
])
#: What the processor adds to a row: the prefix state before it.
RUNNING_OUT = [
    T.StructField("_n", T.LongType()), T.StructField("_nv", T.LongType()), T.StructField("_sum", T.StringType()),
    T.StructField("_sum2", T.StringType()), T.StructField("_days", T.LongType()), T.StructField("_from", T.IntegerType()),
    T.StructField("_to", T.IntegerType()), T.StructField("_method", T.StringType()), T.StructField("_place", T.StringType()),
    T.StructField("_uses", T.LongType()), T.StructField("_recent", T.LongType()), T.StructField("merchant_seen", T.BooleanType()),
    T.StructField("location_seen", T.BooleanType()), T.StructField("_prev_us", T.LongType())]


class RunningBaselineProcessor(StatefulProcessor):
    """O-72: the baseline and history of an account as of each of its rows,
    the same prefix state as ``operators.running``: read -> emit -> update.

    State per account, one entry: counts, exact sums, hours, running modes, the
    times of the last hour, which older ones leave, and a count for each
    merchant, method and place used. A row without a time or amount adds
    nothing to the sums and the last hour; rows that arrive after later ones
    count as earlier for the rows that arrive after them. Rows carry their
    account, merchant, method and place as text in ``key_text``, ``merchant_text``,
    ``method_text`` and ``place_text``.
    """

    HOUR, DAY = 3_600_000_000, 86_400_000_000
    KINDS = ("merchant", "method", "place")

    def __init__(self, ts: str, tie: Sequence[str], keep: Sequence[str], only: str = "PENDING"):
        self.ts, self.tie, self.keep, self.only = ts, list(tie), list(keep), only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accounts = handle.getMapState("accounts", ACCOUNT_KEY, RUNNING_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["key_text", self.ts, *self.tie], kind="mergesort", na_position="last")
        timed = pdf[self.ts].notna()
        columns = [[u if t else None for u, t in zip(_us(pdf[self.ts]).tolist(), timed)], pdf["amount"].tolist(), pdf["status"].tolist(),
                   *[[None if pd.isna(v) else v for v in pdf[f"{kind}_text"]] for kind in self.KINDS]]
        out = []
        for account, i, j in _spans(pdf["key_text"].tolist()):
            self.account(account, zip(*[c[i:j] for c in columns]), out)
        state = pd.DataFrame(out, columns=[f.name for f in RUNNING_OUT], dtype=object)
        yield pd.concat([pdf[self.keep].reset_index(drop=True), state], axis=1)

    def account(self, account: str, rows, out: list) -> None:
        """Adds the state before each of an account's rows to ``out``."""
        s = dict(zip(RUNNING_SCHEMA.names, self.accounts.getValue((account,)))) if self.accounts.containsKey((account,)) else dict(
            n=0, nv=0, cents="0", cents2="0", days=0, last_day=None, from_hour=None, to_hour=None, last_us=None, recent=b"",
            method=None, method_n=0, place=None, place_n=0, uses=b'{"merchant": [], "method": [], "place": []}')
        cents, cents2, recent = int(s["cents"]), int(s["cents2"]), np.frombuffer(s["recent"], np.int64).tolist()
        seen = {kind: dict(map(tuple, used)) for kind, used in json.loads(bytes(s["uses"])).items()}
        for us, amount, status, merchant, method, place in rows:
            near = 0 if us is None else len(recent) - bisect_left(recent, us - self.HOUR)
            uses = seen["merchant"].get(merchant, 0)
            out.append((s["n"], s["nv"], str(cents), str(cents2), s["days"], s["from_hour"], s["to_hour"], s["method"], s["place"],
                        uses, near, uses > 0, place in seen["place"], s["last_us"]))
            s["n"] += 1
            for kind, v in (("merchant", merchant), ("method", method), ("place", place)):
                n = seen[kind][v] = seen[kind].get(v, 0) + 1
                if kind != "merchant" and (kind == "method" or v is not None):
                    best = s[kind]
                    first = s[f"{kind}_n"] == 0
                    if first or (-n, v is not None, v or "") < (-s[f"{kind}_n"], best is not None, best or ""):
                        s[kind], s[f"{kind}_n"] = v, n
            if us is not None:
                hour = us // self.HOUR % 24
                s["from_hour"] = hour if s["from_hour"] is None else min(hour, s["from_hour"])
                s["to_hour"] = hour if s["to_hour"] is None else max(hour, s["to_hour"])
                s["last_us"] = us if s["last_us"] is None else max(us, s["last_us"])
                insort(recent, us)
            if status == self.only:
                if us is not None and us // self.DAY != s["last_day"]:
                    s["days"], s["last_day"] = s["days"] + 1, us // self.DAY
                if not pd.isna(amount):
                    c = int(amount * 100)
                    s["nv"], cents, cents2 = s["nv"] + 1, cents + c, cents2 + c * c
        newest = s["last_us"]
        recent = recent[bisect_left(recent, newest - self.HOUR):] if newest is not None else []
        s |= {"cents": str(cents), "cents2": str(cents2), "recent": np.array(recent, np.int64).tobytes(),
              "uses": json.dumps({kind: list(used.items()) for kind, used in seen.items()}).encode()}
        self.accounts.updateValue((account,), tuple(s[c] for c in RUNNING_SCHEMA.names))

    def close(self) -> None:
        pass
