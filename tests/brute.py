"""Plain restatements of the problems in Python, to hold the operators against on small tables."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections import defaultdict
from decimal import Decimal, InvalidOperation

import pandas as pd

from docloom.operators.instants import FeedZones


def load(folder: str, table: str) -> list[dict]:
    df = pd.read_parquet(f"{folder}/{table}.parquet")
    return df.astype(object).where(df.notna(), None).to_dict("records")


def utc(s) -> int | None:
    if s is None:
        return None
    if isinstance(s, str):
        s = dt.datetime.fromisoformat(s.strip().rstrip("Z"))
    return (pd.Timestamp(s).to_pydatetime() - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def key(v) -> str | None:
    h = re.sub("[^0-9A-Fa-f]", "", v or "").upper()
    return h if len(h) == 32 and set(h) != {"0"} else None


def p1(folder: str) -> set:
    out = set()
    tombs = load(folder, "record_tombstones")
    pol, prem, cust = "ams360_powerbi_basicpolinfo", "ams360_powerbi_policytranpremium", "ams360_powerbi_customer"
    for table, field, to in ((prem, "PolId", pol), (pol, "CustId", cust)):
        births, ends = defaultdict(list), defaultdict(list)
        for r in load(folder, to):
            births[key(r[field])].append(utc(r["_dateUpdated"]))
        for r in tombs:
            if r["collection_name"] == to:
                ends[key(r["record_key"])].append(utc(r["deleted_at"]))
        for r in load(folder, table):
            k, t = key(r[field]), utc(r["_dateUpdated"])
            if k and not any(b <= t and not any(b < e <= t for e in ends[k]) for b in births[k]):
                out.add((table, field, r["_id"]))
    return out


def feeds(folder: str) -> FeedZones:
    return FeedZones([(r["feed_code"], r["tz_name"], r["day_order"], r["std_abbr"], r["dst_abbr"]) for r in load(folder, "feed_zones")])


def typed(v: str, kind: str):
    """The typed value, or None if v can't be read."""
    s = v.strip()
    if kind == "text":
        return s.lower()
    if kind in ("decimal", "integer"):
        s = re.sub(r"[\s$€£¥%]", "", s)
        if re.fullmatch(r"[+-]?\d{1,3}(,\d{3})+(\.\d*)?", s):
            s = s.replace(",", "")
        try:
            n = Decimal(s) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", s) else None
        except InvalidOperation:
            return None
        return None if n is None or kind == "integer" and n != int(n) else n
    if kind == "boolean":
        return {"true": True, "yes": True, "y": True, "1": True, "false": False, "no": False, "n": False, "0": False}.get(s.lower())
    s = re.sub(r"[T ]00:00(:00(\.0+)?)?Z?$", "", s)
    for f in ("%Y-%m-%d", "%Y/%m/%d", "%Y%m%d", "%d %b %Y", "%d.%m.%Y"):
        try:
            return dt.datetime.strptime(s, f).date()
        except ValueError:
            pass
    return None


def offer_events(folder: str) -> dict:
    """(entity, attribute) -> ordered [(instant, id, value or None, old)]."""
    kinds = {r["field_name"].lower(): (r["field_name"], r["value_type"]) for r in load(folder, "offer_fields")}
    zones, out = feeds(folder), defaultdict(list)
    clear = lambda v: v is None or v.strip().lower() in ("", "null")
    for r in load(folder, "flat_offer_history"):
        f = kinds.get((r["Field"] or "").strip().lower())
        at = zones.parse(r["CreatedDate"], r["feed_code"])
        if f is None or at is None or r["ParentId"] is None:
            continue
        v = None if clear(r["NewValue"]) else typed(r["NewValue"], f[1])
        if v is None and not clear(r["NewValue"]):
            continue
        old = None if clear(r["OldValue"]) else typed(r["OldValue"], f[1])
        out[r["ParentId"].strip().lower(), f[0]].append((at, r["_id"], v, old))
    return {k: sorted(v, key=lambda x: x[:2]) for k, v in out.items()}


def p2(folder: str) -> set:
    out = set()
    for (p, f), rows in offer_events(folder).items():
        last = [r for r in rows if r[0] == rows[-1][0]][0]
        if last[2] is not None:
            out.add((p, f, last[1]))
    return out


def p4(folder: str) -> set:
    out = set()
    for (p, f), rows in offer_events(folder).items():
        value, since = rows[0][3], ""
        for _, i, v, _ in rows:
            if v != value:
                if value is not None:
                    out.add((p, f, since, i))
                value, since = v, i
        if value is not None:
            out.add((p, f, since, ""))
    return out


def elements(v) -> list:
    if isinstance(v, str):
        try:
            x = json.loads(v)
            v = x if isinstance(x, dict | list) else v
        except ValueError:
            pass
    return v if isinstance(v, list) else [v] if isinstance(v, dict | str) else []


def p3(folder: str) -> set:
    out = set()

    def emit(table, i, o):
        jov = o.get("jsonObjValues")
        jov = json.loads(jov) if isinstance(jov, str) and jov.startswith("{") else jov
        for path, v in (("jsonObjValues.nestedObjArray", (jov or {}).get("nestedObjArray")), ("jsonObjValues.nestedStrArray", (jov or {}).get("nestedStrArray")), ("jsonArray", o.get("jsonArray"))):
            out.update((table, i, path, n) for n, x in enumerate(elements(v)) if x is not None)

    for r in load(folder, "function_test_raw"):
        try:
            o = json.loads(r["payload"] or "")
            o = json.loads(o) if isinstance(o, str) else o
        except ValueError:
            continue
        if isinstance(o, dict):
            emit("function_test_raw", r["_id"], o)
    for r in load(folder, "function_test_data"):
        arr = lambda v: None if v is None else list(v)
        j = r["jsonObjValues"]
        emit("function_test_data", r["_id"], {"jsonObjValues": j and {k: arr(j[k]) for k in ("nestedObjArray", "nestedStrArray")}, "jsonArray": arr(r["jsonArray"])})
    return out


def p5(folder: str) -> set:
    out = set()
    number = re.compile(r"-?([0-9]+(\.[0-9]{1,4})?|\.[0-9]{1,4})")
    for table, column, good in (
        ("ams360_powerbi_basicpolinfo", "Status", "ACDNR"),
        ("ams360_powerbi_basicpolinfo", "PolType", "BCHMPS"),
        ("ams360_powerbi_policytranpremium", "Premium", None),
    ):
        df = pd.read_parquet(f"{folder}/{table}.parquet", columns=["_id", "load_no", column])
        df["v"] = df[column]
        df["missing"] = df.v.isna() | df.v.isin(["", "NULL"])
        df["ok"] = [not m and (v in list(good) if good else bool(number.fullmatch(v))) for v, m in zip(df.v, df.missing)]
        out |= {(table, column, 0, i) for i in df[~df.missing & ~df.ok]._id}
        for n, g in df.groupby("load_no"):
            if len(g) < 100:
                continue
            differs = g.missing.mean() - df.missing.mean() >= 0.15
            if good:
                share = lambda x, c: (x.v == c).sum() / max(1, (~x.missing).sum())
                differs |= any(abs(share(g, c) - share(df, c)) >= 0.15 for c in good)
            else:
                med = lambda x: x[x.ok].v.astype(float).median()
                differs |= bool(med(g) >= 5 * med(df) or med(g) * 5 <= med(df))
            if differs:
                out.add((table, column, int(n), ""))
    return out


def p6(folder: str) -> set:
    out = set()
    runs = load(folder, "sync_runs")
    for table, k in (("ams360_powerbi_basicpolinfo", "PolId"), ("ams360_powerbi_policytranpremium", "PolTPId")):
        cut = max(utc(r["cutoff_at"]) for r in runs if r["table_name"] == table and r["run_state"] == "succeeded")
        first: dict = {}
        for r in load(folder, table):
            c, me = (key(r[k]), utc(r["ChangedDate"])), (utc(r["_dateUpdated"]), r["_id"])
            first[c] = min(first.get(c, me), me)
        out |= {(table, i) for t, i in first.values() if t >= cut}
    return out


def p7(folder: str) -> set:
    out, zones = set(), feeds(folder)
    for table, field in (("ams360_powerbi_basicpolinfo", "PolEffDate"), ("ams360_powerbi_policytranpremium", "EffDate"), ("flat_offer_history", "CreatedDate"), ("function_test_data", "dateAchieved")):
        for r in load(folder, table):
            v = r[field]
            if v is not None and not re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z", v):
                at = zones.parse(v, r["feed_code"])
                if at is not None:
                    out.add((table, r["_id"], field, at))
    return out
