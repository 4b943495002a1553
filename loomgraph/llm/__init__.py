"""Operations of a training-data pipeline: ten operators on documents and pages, and their queries."""
