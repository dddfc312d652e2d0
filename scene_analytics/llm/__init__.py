"""Operations of a training-data pipeline: search, scanning, filtering, deduplication, tokenising, scoring."""
