"""How queries run: plans, stage figures, overlap reports."""
