"""Column -> Column rules: text, dates, pay, place, company type, liveness, call cost."""
