"""Plain single-threaded models the distributed operators are compared with."""

from __future__ import annotations

import statistics
from collections import deque


def walk_flows(packets, idle, active):
    """Flows of (us, key, forward, length, flags) rows in time order, closed by the packet of anyone."""
    open_flows, done = {}, []

    def close(key, reason, at):
        rows = open_flows.pop(key)
        done.append((key, rows[0][0], rows[-1][0], len(rows), reason, at, summary(rows)))

    for us, key, forward, length, flags in packets:
        for other in list(open_flows):
            rows = open_flows[other]
            if us - rows[-1][0] >= idle:
                close(other, "idle_timeout", us)
            elif us - rows[0][0] >= active:
                close(other, "active_timeout", us)
        open_flows.setdefault(key, []).append((us, forward, length, flags))
        if "RST" in flags or "FIN" in flags:
            close(key, "rst" if "RST" in flags else "fin", us)
    for key in list(open_flows):
        close(key, "flush", open_flows[key][-1][0])
    return done


def summary(rows):
    gaps = [b[0] - a[0] for a, b in zip(rows, rows[1:]) if b[0] > a[0]]
    lengths = [r[2] for r in rows]
    sd = lambda v: statistics.stdev(v) if len(v) > 1 else 0.0
    return (
        sum(r[1] for r in rows), sum(int(r[2]) for r in rows if r[1]), round(statistics.mean(gaps), 3) if gaps else 0.0, round(sd(gaps), 3),
        round(statistics.mean(lengths), 6), round(sd(lengths), 6), sum("SYN" in r[3] for r in rows),
    )


def admit(requests, limit):
    """Decisions of (us, kind, sequence, digest) rows of one sensor."""
    last, digest, times, out = 0, None, deque(), []
    for us, kind, sequence, text in requests:
        if kind == "telemetry" and sequence == last and text == digest:
            out.append("duplicate")
            continue
        if kind == "telemetry" and sequence <= last:
            out.append("conflict")
            continue
        while times and times[0] < us - 60_000_000:
            times.popleft()
        if len(times) >= limit:
            out.append("rate_limited")
            continue
        times.append(us)
        if kind == "telemetry":
            last, digest = sequence, text
        out.append("accepted")
    return out


def buffer(slots, length, on_gap, per_day=8640):
    """Status of time-ordered interval numbers."""
    history, out = [], []
    for n in slots:
        if history and n <= history[-1]:
            out.append("rejected")
            continue
        status = None
        if history and n // per_day != history[-1] // per_day:
            history, status = [], "day_boundary_reset"
        elif history and n != history[-1] + 1:
            if on_gap == "wait":
                out.append("waiting_for_next_valid_state")
                continue
            history, status = [], "gap_reset"
        history = (history + [n])[-length:]
        out.append(status or ("ready" if len(history) == length else "buffering"))
    return out
