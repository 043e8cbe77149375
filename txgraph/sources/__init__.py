"""txgraph.sources"""
