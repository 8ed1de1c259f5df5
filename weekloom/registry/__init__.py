"""All registered queries."""

from weekloom.registry import joins, models, profiles, quality, series, sources, tidy  # noqa: F401
