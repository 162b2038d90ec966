"""The rules in plain Python, for whole series in memory: what the distributed operators must equal."""

import math
from itertools import groupby


def runs(flags):
    """(first, last, flag) of each run."""
    at, out = 0, []
    for flag, members in groupby(flags):
        n = len(list(members))
        out.append((at, at + n - 1, flag))
        at += n
    return out


def smooth(flags, min_motion, min_static, noise):
    once = []
    for a, b, flag in runs(flags):
        n = b - a + 1
        turned = (flag and n < min_motion) or (not flag and n < noise)
        once += [flag != turned] * n
    twice = []
    for a, b, flag in runs(once):
        n = b - a + 1
        twice += [True if n < min_static else flag] * n
    return twice


def merge(parts, tolerance):
    """parts: dicts in order."""
    out = []
    for p in parts:
        if out and out[-1]["state"] == p["state"] and p["start_time"] - out[-1]["end_time"] <= tolerance:
            out[-1] = out[-1] | {"end_time": p["end_time"], "max_energy": max(out[-1]["max_energy"], p["max_energy"])}
        else:
            out.append(dict(p))
    return out


def median(xs, window):
    h = window // 2
    padded = [xs[0]] * h + list(xs) + [xs[-1]] * h
    return [sorted(padded[i : i + window])[h] for i in range(len(xs))]


def early(xs, window, threshold):
    for k in range(window - 1, len(xs)):
        if max(xs[k - window + 1 : k + 1]) < threshold:
            return xs[: k + 1] + [0.0]
    return list(xs)


def percentile(xs, q):
    xs = sorted(xs)
    pos = q * (len(xs) - 1)
    lo, hi = xs[math.floor(pos)], xs[math.ceil(pos)]
    return lo + (hi - lo) * (pos - math.floor(pos))


def pack(files, limit):
    """Batch number of each part, by its file."""
    out, open_files, batch = [], set(), 0
    for f in files:
        if f not in open_files and len(open_files) == limit:
            open_files, batch = set(), batch + 1
        open_files.add(f)
        out.append(batch)
    return out


def absorb(parts, min_motion, min_static, tolerance):
    """Short parts go into the left neighbour of the other state, else into the right one, until nothing changes."""

    def least(p):
        return min_motion if p["state"] == "DYNAMIC" else min_static

    now = [dict(p) for p in parts]
    while True:
        i, changed = 0, False
        while i < len(now):
            p = now[i]
            if p["end_time"] - p["start_time"] < least(p):
                if i > 0 and now[i - 1]["state"] != p["state"]:
                    into, new = now[i - 1], {"end_time": p["end_time"]}
                elif i + 1 < len(now) and now[i + 1]["state"] != p["state"]:
                    into, new = now[i + 1], {"start_time": p["start_time"]}
                else:
                    i += 1
                    continue
                into.update(new, max_energy=max(into["max_energy"], p["max_energy"]))
                del now[i]
                changed = True
            else:
                i += 1
        if not changed:
            return now
        now = merge(now, tolerance)
