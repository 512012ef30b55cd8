"""Formats, fields and detections."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Formats that detection can report.
FORMATS = ("json", "syslog", "apache_common", "apache_combined", "apache_extended", "nginx_access", "nginx_error", "csv", "key_value", "systemd_journal", "custom_delimited", "basic_log", "python_log", "ltsv", "unknown")


@dataclass(frozen=True)
class Field:
    """A field of a format: its type, and whether it holds the line's time."""

    name: str
    data_type: str = "string"
    is_timestamp: bool = False
    frequency: int = 0
    confidence: float = 0.0
    samples: tuple[str, ...] = ()


@dataclass(frozen=True)
class Detection:
    """What is known of a source: format, confidence, fields in order, and details such as the delimiter."""

    format: str
    confidence: float = 0.0
    fields: tuple[Field, ...] = ()
    samples: tuple[str, ...] = ()
    metadata: dict[str, str] = field(default_factory=dict)

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields)


def distinct_names(names: list[str]) -> tuple[str, ...]:
    """The names in order, later ones of equal names numbered: a, b, a gives a, b, a_2."""
    out: list[str] = []
    for n in names:
        k = 1
        while (name := n if k == 1 else f"{n}_{k}") in out:
            k += 1
        out.append(name)
    return tuple(out)


def fields_of(**kinds: str) -> tuple[Field, ...]:
    """Fields by name and type; the type ``timestamp`` marks the line's time."""
    return tuple(Field(k, "string" if v == "timestamp" else v, v == "timestamp") for k, v in kinds.items())
