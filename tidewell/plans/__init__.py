"""Registered queries; importing this package registers all of them."""

from . import analyses, answers, periods, registry, reports, tiers, upkeep  # noqa: F401

#: Reports whose first version read or answered only a part: the whole version goes by the plain name.
WHOLE = {
    "health_summary": "health_summary_full", "daily_snapshot": "daily_snapshot_full", "coaching_brief": "coaching_brief_full", "fitness_markers": "fitness_markers_tiered",
    "recovery_score": "recovery_score_full", "weekly_digest": "weekly_digest_full", "upsert_samples": "upsert_samples_all", "recompute_summaries": "recompute_summaries_all",
}
for _plain, _whole in WHOLE.items():
    registry.QUERIES[_plain], registry.ORACLES[_plain] = registry.QUERIES.pop(_whole), registry.ORACLES.pop(_whole)
