"""Multi-operator plans: validation runs, ladders and report datasets."""
