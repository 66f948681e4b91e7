"""Schemas and tuples of the tests."""

import random

#: Shafts under shafts and guilds in guilds; two relations that recurse through each other, one of them starred.
MINE = """
type person
type guild
  relations
    define sworn: [person, person:*, guild#sworn]
type shaft
  relations
    define beneath: [shaft]
    define surveyor: [person]
    define passes: enters or surveyor
    define enters: passes from beneath or [guild#sworn, person:*]
type seam
  relations
    define cut_by: [shaft]
    define assayer: [person, guild#sworn]
    define hauls: passes from cut_by or assayer
    define maps: surveyor from cut_by
"""

#: Any club's riders and any line that feeds another.
LINES = """
type rider
type club
  relations
    define rides: [club#rides, rider]
type line
  relations
    define feeds: [line:*, line]
    define transfers: [rider:*] or boards
    define boards: transfers from feeds or [club:*#rides, rider]
type stop
  relations
    define served: [line]
    define waits: [club#rides, rider] or transfers from served
"""

#: Star parents of a relation that also takes wildcard objects.
CROSSING = """
type user
type shelf
  relations
    define above: [shelf, shelf:*]
    define finder: [user] or finder from above
type book
  relations
    define on: [shelf, shelf:*]
    define reader: [user:*] or finder from on
"""

#: Stars on either side of an exclusion and an intersection; streets see what their booths hold.
FAIR = """
type visitor
type troupe
  relations
    define cast: [troupe#cast, visitor]
type booth
  relations
    define gate: [visitor:*]
    define ticket: [troupe#cast, visitor]
    define barred: [visitor, troupe#cast]
    define inside: (gate or ticket) but not (barred but not ticket)
    define front: gate and (barred or ticket)
    define never: [visitor] but not [visitor:*]
type street
  relations
    define stands: [booth]
    define crowd: inside from stands
"""

#: Booleans over booleans: who may work at a bench, watch a run, and see it sealed.
LAB = """
type user
type lab
  relations
    define staff: [user, lab#staff]
    define banned: [user]
    define cleared: staff but not banned
type bench
  relations
    define lab: [lab]
    define booked: [user, lab#cleared]
    define visitor: [user:*]
    define closed: [user]
    define operator: booked and cleared from lab
    define watcher: (visitor or operator) but not closed
type run
  relations
    define on: [bench]
    define observer: watcher from on
    define signer: [user] and operator from on
    define sealed: observer but not (signer or [user])
"""

#: A derived relation as a userset, and another inherited from two types.
JURY = """
type citizen
type panel
  relations
    define drawn: [citizen, panel#drawn]
    define excused: [citizen]
    define alternate: [citizen:*, citizen]
    define sits: (drawn but not excused) or (alternate and drawn)
type trial
  relations
    define heard: [panel, trial]
    define clerk: [panel#sits]
    define sits: [citizen]
    define quorum: sits from heard
    define sealed: [citizen:*, citizen] but not (clerk or sits from heard)
"""

ALL = {"mine": (MINE, {("shaft", "enters")}), "lines": (LINES, set()), "crossing": (CROSSING, {("shelf", "finder")}), "fair": (FAIR, set()), "lab": (LAB, set()), "jury": (JURY, set())}


def tuples_of(schema, compiled, seed, n=28):
    """Random admitted tuples over two or three names of each type."""
    rng, names, out = random.Random(seed), ["a", "b", "c"], set()
    for _ in range(n):
        t, r, st, sp, star = rng.choice(compiled.admitted)
        o = "*" if (t, r) in compiled.object_wildcards and rng.random() < 0.2 else rng.choice(names)
        out.add((sp, st, "*" if star else rng.choice(names), r, t, o))
    return sorted(out)
