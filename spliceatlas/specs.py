"""The five event types as data: coordinates, motif regions, wiring of regions to map positions, and window anchors.

Everything that differs between event types is in this module. Fixed values: names, formulas and orders below define
the results. Expressions are SQL over the coordinate columns c2..c9 (c0 is the chromosome, c1 the strand) and the lengths
e (exon), i (intron) and L (intron plus window).
"""

from __future__ import annotations

from dataclasses import dataclass

GROUPS = ("up", "dn", "bg")
CONTRASTS = ("up", "dn")


@dataclass(frozen=True)
class Event:
    name: str
    description: str
    coordinates: int  # chromosome, strand and this many positions
    regions: tuple[str, ...]  # of the motif analysis: name, start and end for plus and for minus
    wiring: tuple[tuple[str, str, str], ...]  # for each map region: motif region, side (P, N or S for scaled), length (e or i)
    names: dict[str, str]  # anchors in 1-based coordinates
    plus: tuple[str, ...]
    minus: tuple[str, ...]
    lengths: str  # of the windows' regions, one letter each
    labels: tuple[str, ...]
    key_columns: int = 4  # columns of the event key in the motif analysis and in the peak renderer

    def motif_regions(self):
        return [tuple(part.strip() for part in r.split("|")) for r in self.regions]


_SE_LABELS = ("UpstreamExon_3prime", "UpstreamExonIntron", "UpstreamIntron", "TargetExon_5prime", "TargetExon-3prime", "DownstreamIntron", "DownstreamExonIntron", "DownstreamExon_5prime")
#: Column names of the summary of smallest p-values for skipped exons; other events use their region labels.
SE_SUMMARY = ("upstreamExon-3prime", "upstreamExonIntron", "upstreamIntron", "targetExon-5prime", "targetExon-3prime", "downstreamIntron", "downstreamExonIntron", "downstreamExon-5prime")


def _numbered(n: int) -> tuple[str, ...]:
    return tuple(f"R{k}" for k in range(1, n + 1))


EVENTS = {
    "SE": Event(
        "SE", "Skipped exon", 6,
        regions=(
            "UpstreamExon | c4 | c5 | c6 | c7",
            "UpstreamExonIntron | c5 | c5 + {L} | c6 - {L} | c6",
            "UpstreamIntron | c2 - {L} | c2 | c3 | c3 + {L}",
            "TargetExon | c2 | c3 | c2 | c3",
            "DownstreamIntron | c3 | c3 + {L} | c2 - {L} | c2",
            "DownstreamExonIntron | c6 - {L} | c6 | c5 | c5 + {L}",
            "DownstreamExon | c6 | c7 | c4 | c5",
        ),
        wiring=(
            ("UpstreamExon", "N", "e"), ("UpstreamExonIntron", "P", "i"), ("UpstreamIntron", "N", "i"), ("TargetExon", "P", "e"),
            ("TargetExon", "N", "e"), ("DownstreamIntron", "P", "i"), ("DownstreamExonIntron", "N", "i"), ("DownstreamExon", "P", "e"),
        ),
        names={"eS": "c2 + 1", "eE": "c3", "uE": "c5", "dS": "c6 + 1"},
        plus=("uE - {e} + 1", "uE + 1", "eS - {i}", "eS", "eE - {e} + 1", "eE + 1", "dS - {i}", "dS"),
        minus=("dS + {e} - 1", "dS - 1", "eE + {i}", "eE", "eS + {e} - 1", "eS - 1", "dS - 1", "dS + {e} - 1"),
        lengths="eiieeiie", labels=_SE_LABELS,
    ),
    "A3SS": Event(
        "A3SS", "Alternative 3' splice site", 6,
        regions=(
            "FlankingExon | c6 | c7 | c6 | c7",
            "FirstIntron | c7 | c7 + {L} | c6 - {L} | c6",
            "secondIntron | c2 - {L} | c2 | c3 | c3 + {L}",
            "SplicingRegion | c2 | c4 | c5 | c3",
            "downstreamExon | c4 | c3 | c2 | c5",
        ),
        wiring=(
            ("FlankingExon", "P", "e"), ("FlankingExon", "N", "e"), ("FirstIntron", "P", "i"), ("secondIntron", "N", "i"),
            ("SplicingRegion", "P", "e"), ("SplicingRegion", "N", "e"), ("downstreamExon", "P", "e"), ("downstreamExon", "N", "e"),
        ),
        names={"LS": "c2 + 1", "LE": "c3", "SS": "c4 + 1", "SE": "c5", "FS": "c6 + 1", "FE": "c7"},
        plus=("FS", "FE - {e} + 1", "FE", "LS - {i} + 1", "LS", "SS - {e}", "SS", "SE - {e} + 1"),
        minus=("FE", "FS + {e} - 1", "FS - 1", "LE + {i}", "LE", "SE + {e} - 1", "SE", "LS + {e} - 1"),
        lengths="eeiieeee", labels=_numbered(8),
    ),
    "A5SS": Event(
        "A5SS", "Alternative 5' splice site", 6,
        regions=(
            "LongExon | c2 | c5 | c4 | c3",
            "SplicingRegion | c5 | c3 | c2 | c4",
            "FirstIntron | c3 | c3 + {L} | c2 - {L} | c2",
            "FlankinfExonIntron | c6 - {L} | c6 | c7 | c7 + {L}",
            "FlankingExon | c6 | c7 | c6 | c7",
        ),
        wiring=(
            ("LongExon", "P", "e"), ("LongExon", "N", "e"), ("SplicingRegion", "P", "e"), ("SplicingRegion", "N", "e"),
            ("FirstIntron", "P", "i"), ("FlankinfExonIntron", "N", "i"), ("FlankingExon", "P", "e"), ("FlankingExon", "N", "e"),
        ),
        names={"LS": "c2 + 1", "LE": "c3", "SS": "c4 + 1", "SE": "c5", "FS": "c6 + 1", "FE": "c7"},
        plus=("LS", "SE - {e} + 1", "SE + 1", "LE - {e} + 1", "LE + 1", "FS - {i}", "FS", "FE - {e} + 1"),
        minus=("SE", "SS + {e} - 1", "SS - 1", "LS + {e} - 1", "LS - 1", "FE + {i} - 1", "FE - 1", "FS + {e} - 1"),
        lengths="eeeeiiee", labels=_numbered(8),
    ),
    "RI": Event(
        "RI", "Retained intron", 6,
        regions=("UpstreamExon | c4 | c5 | c6 | c7", "Intron | c5 | c6 | c5 | c6", "downstreamExon | c6 | c7 | c4 | c5"),
        wiring=(("UpstreamExon", "P", "e"), ("UpstreamExon", "N", "e"), ("Intron", "S", "i"), ("downstreamExon", "P", "e"), ("downstreamExon", "N", "e")),
        names={"uS": "c4 + 1", "uE": "c5", "dS": "c6 + 1", "dE": "c7"},
        plus=("uS", "uE - {e} + 1", "uE", "dS", "dE - {e} + 1"),
        minus=("dE", "dS + {e} - 1", "dS - 1", "uE - 1", "uS + {e} - 1"),
        lengths="eeiee", labels=_numbered(5),
    ),
    "MXE": Event(
        "MXE", "Mutually exclusive exons", 8,
        regions=(
            "UpstreamExon | c6 | c7 | c8 | c9",
            "FirstIntron | c7 | c7 + {L} | c8 - {L} | c8",
            "SecondIntron | c2 - {L} | c2 | c5 | c5 + {L}",
            "FirstExon | c2 | c3 | c4 | c5",
            "thirdIntron | c3 | c3 + {L} | c4 - {L} | c4",
            "fourthIntron | c4 - {L} | c4 | c3 | c3 + {L}",
            "SecondExon | c4 | c5 | c2 | c3",
            "fifthIntron | c5 | c5 + {L} | c2 - {L} | c2",
            "sixthIntron | c8 - {L} | c8 | c7 | c7 + {L}",
            "downstreamExon | c8 | c9 | c6 | c7",
        ),
        wiring=(
            ("UpstreamExon", "N", "e"), ("FirstIntron", "P", "i"), ("SecondIntron", "N", "i"), ("FirstExon", "P", "e"), ("FirstExon", "N", "e"), ("thirdIntron", "P", "i"),
            ("fourthIntron", "N", "i"), ("SecondExon", "P", "e"), ("SecondExon", "N", "e"), ("fifthIntron", "P", "i"), ("sixthIntron", "N", "i"), ("downstreamExon", "P", "e"),
        ),
        names={"aS": "c2 + 1", "aE": "c3", "bS": "c4 + 1", "bE": "c5", "uS": "c6 + 1", "uE": "c7", "dS": "c8 + 1", "dE": "c9"},
        plus=("uE - {e} + 1", "uE", "aS - {i} + 1", "aS", "aE - {e} + 1", "aE", "bS - {i} + 1", "bS", "bE - {e} + 1", "bE", "dS - {i} + 1", "dS"),
        minus=("dS + {e}", "dS - 1", "bE + {i}", "bE - 1", "bS + {e}", "bS - 1", "aE + {i}", "aE - 1", "aS + {e}", "aS - 1", "uE + {i}", "uE - 1"),
        lengths="eiieeiieeiie", labels=_numbered(12), key_columns=6,
    ),
}


def event(name: str) -> Event:
    try:
        return EVENTS[name.upper()]
    except KeyError:
        raise ValueError(f"unknown event type {name!r}; supported: {', '.join(EVENTS)}") from None


def list_supported_events() -> list[str]:
    return list(EVENTS)


def event_description(name: str) -> str:
    return event(name).description
