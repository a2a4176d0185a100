"""Column functions."""

from podium.functions.text import board_key, change_text, score_text
from podium.functions.times import day_of, event_ms, iso_ms, iso_text, week_number, week_start

__all__ = ["board_key", "change_text", "day_of", "event_ms", "iso_ms", "iso_text", "score_text", "week_number", "week_start"]
