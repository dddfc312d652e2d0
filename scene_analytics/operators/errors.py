class AnalysisError(ValueError):
    """The input can't be analysed: it is empty, or its shapes don't agree."""
