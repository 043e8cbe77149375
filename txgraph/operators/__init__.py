"""txgraph.operators"""
