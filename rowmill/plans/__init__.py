"""Multi-stage plans: hot-group windows, exact medians and step chains."""
