"""Serving policy: decided on training and validation rows alone, signed, frozen, and checked for drift later."""

from __future__ import annotations

import argparse
import json
import math
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import signature
from tidemark.operators.segments import clip_audit
from tidemark.sources.artifacts import read_json, write_if_changed

#: Numbers under this key may differ by this much between platforms; all else must be equal.
EVIDENCE, TOLERANCE = "evidence", 0.5
STAMPS = ("frozen_at_utc", "content_sha256")


def decide(train: DataFrame, validation: DataFrame, y: str, pred: str) -> dict:
    """Clip at zero if the target is never negative in training, the model goes below zero, and validation gets no worse; else no policy."""
    floor = train.agg(F.min(y)).first()[0]
    found = {name: clip_audit(df, y, pred).first().asDict() for name, df in (("train", train), ("validation", validation))}
    d1 = floor is not None and floor >= 0
    d2 = any(e["n_negative"] > 0 for e in found.values())
    v = found["validation"]
    d3 = v["mae_clipped"] is not None and v["mae_clipped"] <= v["mae_raw"]
    return {
        "policy_id": "non_negative_projection" if d1 and d2 and d3 else "none",
        "decision": {"floor_not_negative": d1, "goes_below_floor": d2, "validation_not_worse": d3}, "floor": floor,
        "selected_on": ["train", "validation"], "final_test_used": False, EVIDENCE: found,
    }


def content(policy: dict) -> dict:
    return {k: v for k, v in policy.items() if k not in STAMPS}


def sign(policy: dict, stamp: str) -> dict:
    """With the time of freezing and the signature of the content, which the time is no part of."""
    return content(policy) | {"frozen_at_utc": stamp, "content_sha256": signature(content(policy))}


def is_intact(policy: dict) -> bool:
    return policy.get("content_sha256") == signature(content(policy))


def leaves(document: object) -> dict[str, tuple[bool, object]]:
    """Each path of a document with whether it lies under the evidence, and its value; an empty object or list is a value."""
    todo, out = [("", False, document)], {}
    while todo:
        path, loose, value = todo.pop()
        if isinstance(value, dict) and value:
            todo += [(f"{path}.{k}" if path else str(k), loose or k == EVIDENCE, v) for k, v in value.items()]
        elif isinstance(value, list) and value:
            todo += [(f"{path}[{i}]", loose, v) for i, v in enumerate(value)]
        else:
            out[path] = (loose, value)
    return out


def differences(a: object, b: object) -> list[str]:
    """Where two documents differ, by path: exactly everywhere, but for floats under the evidence, which may stray by TOLERANCE. A bool is no int."""
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)

    def same(loose: bool, x: object, y: object) -> bool:
        if loose and number(x) and number(y) and float in (type(x), type(y)):
            return math.isclose(x, y, rel_tol=0, abs_tol=TOLERANCE)
        return type(x) is type(y) and x == y

    x, y = leaves(a), leaves(b)
    out = [f"{k}: only in the first" for k in x.keys() - y.keys()] + [f"{k}: only in the second" for k in y.keys() - x.keys()]
    out += [f"{k}: {x[k][1]!r} against {y[k][1]!r}" for k in x.keys() & y.keys() if not same(x[k][0], x[k][1], y[k][1])]
    return sorted(out)


def freeze(policy: dict, path: str | Path, stamp: str, check: bool = False, force: bool = False) -> tuple[int, str]:
    """(exit code, what happened): 0 new, equal or forced; 1 drift; 2 a frozen file that is missing (check) or was tampered with.

    A file that is equal is left byte for byte. check never writes.
    """
    path = Path(path)
    old = read_json(path)
    if old is None:
        if check:
            return 2, "nothing is frozen"
        write_if_changed(path, json.dumps(sign(policy, stamp), indent=2, sort_keys=True, allow_nan=False) + "\n")
        return 0, "frozen"
    intact = is_intact(old)
    found = differences(content(old), json.loads(json.dumps(policy)))
    if intact and not found:
        return 0, "equal"
    if force and not check:
        write_if_changed(path, json.dumps(sign(policy, stamp), indent=2, sort_keys=True, allow_nan=False) + "\n")
        return 0, "frozen anew"
    if not intact:
        return 2, "the frozen file does not bear its own signature"
    return 1, "\n".join(found)


def require_frozen(policy: dict | None) -> dict:
    """The policy, for an audit of the final test; refuses without one, and with one that the final test helped to choose."""
    if policy is None:
        raise RuntimeError("no policy is frozen")
    if policy.get("final_test_used") or not is_intact(policy):
        raise RuntimeError("the policy was chosen with the final test, or changed since")
    return policy


def main(argv: list[str] | None = None) -> int:
    """python -m tidemark.plans.policy CANDIDATE FROZEN [--check] [--force]: freezes a decided policy; exit code 0, 1 (drift) or 2 (missing or broken)."""
    args = argparse.ArgumentParser(description="Freezes a serving policy.")
    args.add_argument("candidate")
    args.add_argument("frozen")
    args.add_argument("--check", action="store_true", help="compare only, never write")
    args.add_argument("--force", action="store_true", help="freeze anew where the two differ")
    found = args.parse_args(argv)
    policy = read_json(found.candidate)
    if not isinstance(policy, dict):
        print(f"{found.candidate} holds no policy")
        return 2
    code, text = freeze(content(policy), found.frozen, datetime.now(timezone.utc).isoformat(timespec="seconds"), found.check, found.force)
    print(text)
    return code


if __name__ == "__main__":
    raise SystemExit(main())
