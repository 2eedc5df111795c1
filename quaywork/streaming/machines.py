"""What the streams keep for each key, and what rows and timers do to it. Times are microseconds since 1970."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor


def _rearm(handle, at_us: list[int]) -> None:
    """One timer, at the first of some times; none without."""
    for t in list(handle.listTimers()):
        handle.deleteTimer(t)
    if at_us:
        handle.registerTimer(min(at_us) // 1000 + 1)


class Exits(StatefulProcessor):
    """Bars and positions of a symbol, taken in order of time once the watermark has passed them."""

    def __init__(self, expire_us: int | None):
        self.expire = expire_us

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, kind string, id long, up boolean, x double, y double, z double")
        self.open = handle.getListState("open", "us long, id long, up boolean, stop double, target double")
        self.last = handle.getValueState("last", "us long, close double")

    def handleInputRows(self, key, rows, timerValues):
        new = []
        for f in rows:
            new += zip(f["us"].tolist(), f["kind"], f["id"].fillna(0).astype("int64").tolist(), f["up"].fillna(False).astype(bool).tolist(), *[f[c].fillna(0.0).tolist() for c in "xyz"], strict=True)
        if new:
            self.waiting.appendList(new)
            self._arm([r[0] for r in new])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get())
        ready, left = [r for r in rows if r[0] < passed], [r for r in rows if r[0] >= passed]
        held, last, out, ended = list(self.open.get()), self.last.get() if self.last.exists() else None, [], False

        def expire(now: int) -> list:
            kept = []
            for p in held:
                if self.expire is not None and now >= p[0] + self.expire:
                    out.append((p[1], key[0], p[0] + self.expire, last and last[1], "expired"))
                else:
                    kept.append(p)
            return kept

        for us, kind, id_, up, x, y, z in ready:  # of one time bars come first, then positions, then an end
            held = expire(us)
            if kind == "p":
                held.append((us, id_, up, x, y))
                ended = False
            elif kind == "z":
                out += [(p[1], key[0], last and last[0], last and last[1], "end_of_data") for p in held]
                held, ended = [], True
            else:
                kept = []
                for p in held:
                    _, n, long, stop, target = p
                    if us <= p[0]:
                        kept.append(p)
                    elif y <= stop if long else x >= stop:
                        out.append((n, key[0], us, stop, "stop"))
                    elif x >= target if long else y <= target:
                        out.append((n, key[0], us, target, "target"))
                    else:
                        kept.append(p)
                held, last, ended = kept, (us, z), False
        held = expire(passed)
        for state, values in ((self.waiting, left), (self.open, held)):
            if values:
                state.put(values)
            else:
                state.clear()
        if last is None or (ended and not left):
            self.last.clear()
        else:
            self.last.update(last)
        self._arm([r[0] for r in left] + ([p[0] + self.expire for p in held] if self.expire is not None else []), True)
        if out:
            yield pd.DataFrame(out, columns=["id", "symbol", "us", "price", "reason"]).astype({"us": "Int64"})

    def _arm(self, times: list[int], anew: bool = False) -> None:
        at = [] if anew else [t * 1000 for t in self.handle.listTimers()]
        if anew or not at or min(times) < min(at):
            _rearm(self.handle, times)

    def close(self):
        pass


class _Lane(StatefulProcessor):
    """What the keys of one lane hold, as one value, and one timer at the first of their times.

    A key of its own costs calls to the state store whenever it has rows or a timer, so many keys share a lane. ``keys``
    is a JSON list of a key and what it holds.
    """

    def init(self, handle):
        self.handle = handle
        self.held = handle.getValueState("held", "keys string, armed long")

    def _load(self) -> tuple[dict, int | None]:
        found = self.held.get()
        return ({}, None) if found is None else ({k[0]: k[1:] for k in json.loads(found[0])}, found[1])

    def _save(self, keys: dict, armed: int | None, at_us: list[int]) -> None:
        due = min(at_us) // 1000 + 1 if at_us else None
        if due != armed:
            if armed is not None:
                self.handle.deleteTimer(armed)
            if due is not None:
                self.handle.registerTimer(due)
        if keys:
            self.held.update((json.dumps([[k, *v] for k, v in keys.items()], separators=(",", ":")), due))
        else:
            self.held.clear()

    def close(self):
        pass


class Silence(_Lane):
    """The last time of each symbol that the watermark has passed, what has been said of it since, and times that wait."""

    def __init__(self, stale_us: int, very_us: int):
        self.stale, self.very = stale_us, very_us

    def handleInitialState(self, key, initialState, timerValues):
        symbols, armed = self._load()
        for symbol, us in zip(initialState["symbol"].tolist(), initialState["us"].tolist(), strict=True):
            since = max(int(us), symbols[symbol][0] if symbol in symbols else int(us))
            symbols[symbol] = [since, False, "fresh", []]
        self._save(symbols, armed, self._times(symbols))

    def handleInputRows(self, key, rows, timerValues):
        new: dict = {}
        for f in rows:
            for symbol, us in zip(f["symbol"].tolist(), f["us"].tolist(), strict=True):
                new.setdefault(symbol, set()).add(us)
        if new:
            symbols, armed = self._load()
            for symbol, times in new.items():
                symbols.setdefault(symbol, [None, False, "", []])[3] += sorted(times)
            self._save(symbols, armed, self._times(symbols))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        symbols, armed = self._load()
        out: list[tuple] = []
        for symbol, held in symbols.items():
            self._pass(symbol, held, passed, out)
        self._save(symbols, armed, self._times(symbols))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "last_us", "state", "at_us"]).astype({"last_us": "Int64"})

    def _pass(self, symbol, held: list, passed: int, out: list[tuple]) -> None:
        """Takes the times of a symbol that the watermark has passed, in order."""
        last, seen, said, waiting = held

        def silent_until(now: int) -> None:
            nonlocal said
            if said == "fresh" and now > last + self.stale:
                said = "stale"
                out.append((symbol, last if seen else None, said, last + self.stale))
            if said == "stale" and seen and now > last + self.very:
                said = "very_stale"
                out.append((symbol, last, said, last + self.very))

        for t in sorted(t for t in waiting if t < passed):
            if last is not None:
                silent_until(t)
            back = last is not None and said != "fresh"
            last, seen, said = t, True, "fresh"
            if back:
                out.append((symbol, t, said, t))
        if last is not None:
            silent_until(passed)
        held[:] = last, seen, said, [t for t in waiting if t >= passed]

    def _times(self, symbols: dict) -> list[int]:
        """The times at which there is something to do."""
        at = []
        for last, seen, said, waiting in symbols.values():
            at += [min(waiting)] if waiting else []
            at += [last + self.stale] if said == "fresh" else [last + self.very] if said == "stale" and seen else []
        return at


class Settlement(_Lane):
    """The last final update of each market, and its positions with what has been said of them."""

    def __init__(self, keep_us: int):
        self.keep = keep_us

    def handleInputRows(self, key, rows, timerValues):
        new: dict = {}
        for f in rows:
            for row in zip(*(f[c].tolist() for c in ("ticker", "seen", "us", "id", "a", "b", "reward", "risk")), strict=True):
                new.setdefault(row[0], []).append(row[1:])
        if not new:
            return
        markets, armed = self._load()
        out: list[tuple] = []
        for ticker, given in new.items():
            self._settle(ticker, markets.setdefault(ticker, [None, None, []]), given, out)
        self._save(markets, armed, [until for _, until, _ in markets.values() if until is not None])
        if out:
            yield pd.DataFrame(out, columns=["id", "ticker", "state", "pnl", "revision"])

    def _settle(self, ticker, market: list, given: list[tuple], out: list[tuple]) -> None:
        final, until, held = market
        final = final and tuple(final)
        for _, us, id_, a, b, reward, risk in given:
            if pd.isna(id_):
                # of two updates at one time the greater counts, whichever comes first
                final = max(final or (us, a, b or ""), (us, a, b or ""))
            else:
                held.append([int(id_), us, a, int(reward), int(risk), "", 0, -1])
        for p in held if final is not None else ():
            id_, us, side, reward, risk, said, pnl, revision = p
            if us <= final[0]:
                won = (side == "sell_yes") == (final[2] == "no")
                new = (final[1], 0 if final[1] == "void" else reward if won else -risk)
                if new != (said, pnl) or revision < 0:
                    p[5:] = *new, revision + 1
                    out.append((id_, ticker, *new, revision + 1))
        market[:] = final, until if final is None else max(int(g[0]) for g in given) + self.keep, held

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        markets, armed = self._load()
        for market in markets.values():
            final, until, held = market
            if until is not None and until // 1000 + 1 <= passed:
                market[:] = final, None, [p for p in held if p[7] < 0]  # the settled ones are done with
        self._save(markets, armed, [until for _, until, _ in markets.values() if until is not None])
        return iter(())
