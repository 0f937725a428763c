"""Operators on samples, graphs, trees and mixtures."""
