"""Set-wise edit analytics on Spark: cuts, music, slots, candidates, keyframes and quality gates."""
