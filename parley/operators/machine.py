"""A state machine run over dialogues, one fold per dialogue.

The machine is driver-sized configuration and becomes literals of the plan; a
dialogue's turns are an array, and the fold is a higher-order aggregate, so
dialogues run in parallel and state never leaves the row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.texts import bare_farewell, slots

Guard = Callable[[Column, Column], Column]


@dataclass
class Machine:
    """Edges are (event, source, dest, guard name or None); ``*`` is any source but the destination.

    ``auto`` edges (state, guard, event, same turn) fire by themselves in order after a turn, at most once each;
    with ``same turn`` false one fires only if the turn began in its state.
    """

    initial: str
    edges: list[tuple[str, str, str, str | None]]
    states: list[str]
    fields: dict[str, str]
    guards: dict[str, Guard] = field(default_factory=dict)
    auto: list[tuple[str, str, str, bool]] = field(default_factory=list)
    collecting: str | None = None
    changed_event: str = "data_changed"
    farewell_event: str = "farewell"
    farewells: tuple[str, ...] = ("bye", "goodbye")
    courtesy: tuple[str, ...] = ("thanks", "thank", "you", "ok", "and")

    def expanded(self) -> list[tuple[str, str, str, str | None]]:
        out = []
        for event, source, dest, guard in self.edges:
            out += [(event, s, dest, guard) for s in (self.states if source == "*" else [source]) if source != "*" or s != dest]
        return out


def holds(keys: list[str]) -> Guard:
    """All of these fields are held."""
    return lambda held, intent: F.forall(F.array(*map(F.lit, keys)), lambda k: F.map_contains_key(held, k))


def holds_for_intent(required: dict[str, list[str]]) -> Guard:
    """All fields that the intent asks for are held; an unknown intent asks for nothing that can be met."""
    table = F.create_map(*[x for k, v in required.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if required else None
    return lambda held, intent: F.coalesce(F.forall(F.try_element_at(table, F.coalesce(intent, F.lit(""))), lambda k: F.map_contains_key(held, k)), F.lit(False))


_TRANSITION = "array<struct<turn:int,source:string,dest:string,event:string,valid:boolean,blocked_by_guard:boolean,fired_by:string>>"


def run(turns: Column, m: Machine) -> Column:
    """Struct (state, intent, held, transitions) after an array of (message, event, intent) turns.

    ``event`` and ``intent`` of a turn are a classifier's (replayed) answer; rules
    come first: a bare farewell, then a held value that changed while collecting.
    """
    lookup = F.create_map(*[x for e, s, d, _ in m.expanded() for x in (F.lit(f"{s}|{e}"), F.lit(d))])
    guarded = [(f"{s}|{e}", g) for e, s, _, g in m.expanded() if g]

    def allowed(key: Column, held: Column, intent: Column) -> Column:
        ok = F.lit(True)
        for name in sorted({g for _, g in guarded}):
            keys = [k for k, g in guarded if g == name]
            ok = F.when(key.isin(keys), m.guards[name](held, intent)).otherwise(ok)
        return ok

    def fire(s: Column, event: Column, by: str, wanted: Column) -> Column:
        """Try one edge; a refused one stays and is recorded, an unwanted one is not."""

        def of(k: Column) -> Column:
            dest = F.try_element_at(lookup, k["key"])
            ok = dest.isNotNull() & allowed(k["key"], s["held"], s["intent"])
            row = F.struct(s["turn"].alias("turn"), s["state"].alias("source"), F.when(ok, dest).otherwise(s["state"]).alias("dest"), event.alias("event"), ok.alias("valid"), (dest.isNotNull() & ~ok).alias("blocked_by_guard"), F.lit(by).alias("fired_by"))
            return F.struct(F.when(k["wanted"] & ok, dest).otherwise(s["state"]).alias("state"), s["intent"].alias("intent"), s["held"].alias("held"), F.when(k["wanted"], F.concat(s["transitions"], F.array(row))).otherwise(s["transitions"]).cast(_TRANSITION).alias("transitions"), s["turn"].alias("turn"), s["began"].alias("began"))

        return F.transform(F.array(F.struct(F.concat_ws("|", s["state"], event).alias("key"), wanted.alias("wanted"))), of)[0]

    def bound(value: Column, f: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), f)[0]

    def automatic(state: str, guard: str, event: str, same_turn: bool) -> Callable[[Column], Column]:
        return lambda x: fire(x, F.lit(event), "auto", (x["state"] == state) & m.guards[guard](x["held"], x["intent"]) & (F.lit(same_turn) | (x["began"] == state)))

    def step(s: Column, t: Column) -> Column:
        found = slots(t["message"], m.fields)

        def of(x: Column) -> Column:
            changed = F.size(F.map_filter(x["found"], lambda k, v: F.coalesce(F.try_element_at(s["held"], k) != v, F.lit(False)))) > 0
            held = F.map_concat(F.map_filter(s["held"], lambda k, v: ~F.map_contains_key(x["found"], k)), x["found"])
            event = F.when(bare_farewell(t["message"], list(m.farewells), list(m.courtesy)), m.farewell_event)
            if m.collecting:
                event = event.when((s["state"] == m.collecting) & changed, m.changed_event)
            # The first intent stays until a turn names another one.
            start = F.struct(s["state"].alias("state"), F.coalesce(t["intent"], s["intent"]).alias("intent"), held.alias("held"), s["transitions"].alias("transitions"), (s["turn"] + 1).alias("turn"), s["state"].alias("began"))
            return F.struct(start.alias("start"), event.otherwise(t["event"]).alias("event"))

        moved = bound(bound(F.struct(found.alias("found")), of), lambda x: fire(x["start"], x["event"], "user", x["event"].isNotNull()))
        for edge in m.auto:
            moved = bound(moved, automatic(*edge))
        return moved

    zero = F.struct(F.lit(m.initial).alias("state"), F.lit(None).cast("string").alias("intent"), F.create_map().cast("map<string,string>").alias("held"), F.array().cast(_TRANSITION).alias("transitions"), F.lit(0).alias("turn"), F.lit(m.initial).alias("began"))
    return F.aggregate(turns, zero, step, lambda s: F.struct(s["state"].alias("state"), s["intent"].alias("intent"), s["held"].alias("held"), s["transitions"].alias("transitions")))


def stop_reason(agent_ended: Column, goal_reached: Column, gave_up: Column, script_complete: Column, turn: Column, max_turns: Column) -> Column:
    """Which stop a turn makes, the first that holds: the agent's end, the goal or giving up once the script is complete, the last turn."""
    return F.when(agent_ended, "agent_ended").when(goal_reached & script_complete, "goal_reached").when(gave_up & script_complete, "gave_up").when(turn >= max_turns, "max_turns")
