"""txgraph.plans"""
