"""Continuous scoring of request streams."""
